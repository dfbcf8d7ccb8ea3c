"""Schemas of the engine's tables; nothing is inferred."""

REQUEST = (
    "id string, transaction struct<amount:double,installments:int,requested_at:string>, "
    "customer struct<avg_amount:double,tx_count_24h:int,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:double>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>, "
    "last_transaction struct<timestamp:string,km_from_current:double>"
)
REFERENCE = "vector array<float>, label string"
META = "format string, version int, quant_scale int, n long, k int"
