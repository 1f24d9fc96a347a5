"""Record layouts as DDL. Reading is always by explicit schema, never by inference."""

from __future__ import annotations

HEADERS_DDL = "array<struct<key:string,value:binary>>"
MONEY_DDL = "decimal(18,2)"
ADDRESS_DDL = "struct<street:string,city:string,state:string,postal_code:string,country:string>"

LOG = (
    "topic string, partition int, offset bigint, key string, value string, "
    f"headers {HEADERS_DDL}, timestamp timestamp"
)
ORDER_EVENT = (
    "order_id string, customer_id string, status string, "
    "items array<struct<product_id:string,product_name:string,quantity:int,"
    f"unit_price:{MONEY_DDL},total_price:{MONEY_DDL}>>, total_amount {MONEY_DDL}, "
    f"shipping_address {ADDRESS_DDL}, billing_address {ADDRESS_DDL}, "
    "order_timestamp timestamp_ntz, metadata map<string,string>"
)
PAYMENT_EVENT = (
    "payment_id string, order_id string, customer_id string, status string, "
    f"amount {MONEY_DDL}, currency string, payment_method struct<type:string,card_last_four:string,"
    "card_brand:string,bank_name:string,wallet_provider:string>, transaction_id string, "
    "gateway_response string, payment_timestamp timestamp_ntz, metadata map<string,string>"
)
GENERIC_MESSAGE = (
    "type string, data variant, metadata variant, schema_version string"
)
FLAT_ORDER = (
    "orderId string, customerId string, amount double, status string, timestamp string"
)
FLAT_PAYMENT = (
    "paymentId string, orderId string, amount double, method string, status string, timestamp string"
)
NOTIFICATION = (
    "type string, recipient string, subject string, content string, timestamp string"
)
OFFSETS = (
    "group string, topic string, partition int, committed bigint, end_offset bigint, ts timestamp"
)
MEMBERS = ("group string, ts timestamp, consumer_id string, partitions int")
OWNERS = (
    "owner string, rack string, priority string, capacity int, region string, "
    "capabilities array<string>, preferences array<string>"
)
FAILURES = (
    f"{LOG}, exception_class string, exception_message string, error_code string, "
    "service_name string, field_name string, validation_rule string, "
    "correlation_id string, attempt int, failed_at timestamp"
)
METRIC = "name string, tags map<string,string>, ts timestamp, value double"

# The states and types a typed event may carry.
ORDER_STATUSES = [
    "PENDING", "CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED", "REFUNDED",
]
PAYMENT_STATUSES = [
    "PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED", "REFUNDED", "PARTIALLY_REFUNDED",
]
PAYMENT_TYPES = [
    "CREDIT_CARD", "DEBIT_CARD", "BANK_TRANSFER", "DIGITAL_WALLET", "CRYPTOCURRENCY",
    "BUY_NOW_PAY_LATER",
]
