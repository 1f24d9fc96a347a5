"""Logs and snapshots derived row by row from the shared tables.

Everything is a projection of a table, except the order log with regions (customer and
nation look-ups) and the offset and member snapshots (aggregates of the notification log). Nothing is collected or generated on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.functions.headers import add_headers, header, header_if, no_headers
from tidelog.schema import HEADERS_DDL
from tidelog.session import use_utc

AS_OF = "2024-01-31 00:00:00"
LOG_COLUMNS = ["topic", "partition", "offset", "key", "value", "headers", "timestamp"]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _every(n: int, rest: int, k: str = "k") -> Column:
    return F.col(k) % n == rest


class Tables:
    """The shared parquet tables of one directory and the logs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = use_utc(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- record logs -------------------------------------------------------------

    def _order_rows(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("k"),
            F.col("o_custkey").alias("custkey"),
            F.col("o_orderstatus").alias("state"),
            F.col("o_orderpriority").alias("urgency"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        )

    @staticmethod
    def _placed(topic: str, *, k: str = "k") -> list[Column]:
        return [
            F.lit(topic).alias("topic"),
            (F.col(k) % 3).cast("int").alias("partition"),
            F.expr(f"{k} div 3").alias("offset"),
        ]

    @staticmethod
    def _order_key() -> Column:
        return (
            F.when(_every(40, 7), F.lit(None).cast("string"))
            .when(_every(50, 3), _text("test-", F.col("custkey")))
            .otherwise(_text("customer-", F.col("custkey")))
        )

    @staticmethod
    def _customer_json() -> Column:
        return F.when(_every(97, 5), F.lit("null")).otherwise(
            _text('"CUST-', F.col("custkey"), '"')
        )

    @staticmethod
    def _damaged(value: Column) -> Column:
        return (
            F.when(_every(60, 11), F.lit(None).cast("string"))
            .when(_every(60, 12), F.lit("   "))
            .when(_every(60, 13), F.lit("not json"))
            .otherwise(value)
        )

    @staticmethod
    def _order_headers() -> Column:
        return add_headers(
            no_headers(),
            header("source", F.lit("web")),
            header_if(_every(11, 0), "source", F.lit("batch")),
        )

    @staticmethod
    def _order_time() -> Column:
        back = F.make_dt_interval(hours=(F.col("k") % 36).cast("int"),
                                  secs=(F.col("k") % 3600).cast("decimal(18,6)"))
        return F.lit(AS_OF).cast("timestamp") - back

    def orders_log(self, region: bool = False) -> DataFrame:
        """One record per order. ``region`` adds the customer's region to the message, at
        the price of a join with customers; only region-aware operators ask for it."""
        rows = self._order_rows()
        region_json = F.lit("")
        if region:
            rows = self._with_region(rows)
            region_json = _text(',"region":"', F.col("region"), '"')
        status = (
            F.when(_every(25, 0), "CANCELLED")
            .when(_every(25, 1), "DRAFT")
            .when(F.col("state") == "P", "PENDING")
            .when(F.col("state") == "O", "CONFIRMED")
            .otherwise("DELIVERED")
        )
        priority = (
            F.when(F.col("urgency") == "1-URGENT", ',"priority":"CRITICAL"')
            .when(F.col("urgency") == "2-HIGH", ',"priority":"HIGH"')
            .when(F.col("urgency") == "3-MEDIUM", ',"priority":"NORMAL"')
            .when(F.col("urgency") == "5-LOW", ',"priority":"LOW"')
            .otherwise("")
        )
        note = F.when(_every(60, 14), "TEST").when(_every(60, 15), "RETRY_ERROR").otherwise("ok")
        value = _text(
            '{"orderId":"ORD-', F.col("k"), '","customerId":', self._customer_json(),
            ',"amount":', F.col("price"), ',"status":"', status, '","note":"', note, '"',
            priority, region_json, "}",
        )
        return rows.select(
            *self._placed("orders-topic"), self._order_key().alias("key"),
            self._damaged(value).alias("value"), self._order_headers().alias("headers"),
            self._order_time().alias("timestamp"),
        )

    def _with_region(self, rows: DataFrame) -> DataFrame:
        # nation and region are fixed lists; the customer side is left to the size check
        # that the adaptive planner makes at run time
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.col("n_nationkey"),
            F.when(F.col("r_name") == "AMERICA",
                   F.when(F.col("n_nationkey") % 2 == 0, "us-east").otherwise("us-west"))
            .otherwise(F.lower("r_name")).alias("region"),
        )
        homes = self.table("customer").select("c_custkey", "c_nationkey")
        return rows.join(homes, F.col("custkey") == F.col("c_custkey"), "left").join(
            places, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        ).drop("c_custkey", "c_nationkey", "n_nationkey").withColumn(
            "region", F.coalesce("region", F.lit("none"))
        )

    def payments_log(self) -> DataFrame:
        """One record per order; statuses rotate, some amounts are zero or below one."""
        amount = (
            F.when(_every(30, 0), F.lit("0.00")).when(_every(30, 1), F.lit("0.50"))
            .otherwise(F.col("price").cast("string"))
        )
        states = F.array(*[F.lit(s) for s in (
            "PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED", "REFUNDED",
            "PARTIALLY_REFUNDED")])
        status = F.element_at(states, (F.col("k") % 7 + 1).cast("int"))
        note = F.when(_every(70, 9), "PAYMENT_SERVICE_DOWN").otherwise("ok")
        value = _text(
            '{"paymentId":"PAY-', F.col("k"), '","orderId":"ORD-', F.col("k"),
            '","customerId":', self._customer_json(), ',"amount":', amount,
            ',"status":"', status, '","note":"', note, '"}',
        )
        return self._order_rows().select(
            *self._placed("payments-topic"), self._order_key().alias("key"),
            self._damaged(value).alias("value"), self._order_headers().alias("headers"),
            self._order_time().alias("timestamp"),
        )

    def notifications_log(self) -> DataFrame:
        """One record per event."""
        recipient = (
            F.when(_every(20, 0), ',"recipient":null').when(_every(20, 1), "")
            .otherwise(_text(',"recipient":"user-', F.col("user_id"), '"'))
        )
        value = _text(
            '{"type":"', F.col("event_type"), '"', recipient,
            ',"subject":"event ', F.col("k"), '","content":"notice"}',
        )
        return self._event_rows().select(
            *self._placed("notifications-topic"), _text("user-", F.col("user_id")).alias("key"),
            value.alias("value"), no_headers().alias("headers"), "timestamp",
        )

    def all_logs(self) -> DataFrame:
        return (
            self.orders_log().unionByName(self.payments_log())
            .unionByName(self.notifications_log())
        )

    def _event_rows(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("timestamp"),
            "user_id", "event_type", "value", "props",
        )

    def payloads(self) -> DataFrame:
        """Whole documents, pages and conversation turns as record values."""
        none = no_headers().alias("headers")
        at = F.lit(AS_OF).cast("timestamp").alias("timestamp")
        docs = self.table("documents").select(
            *self._placed("documents-topic", k="doc_id"),
            F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"),
            F.array(header("lang", F.col("lang")), header("source", F.col("source")))
            .cast(HEADERS_DDL).alias("headers"),
            (F.lit(AS_OF).cast("timestamp")
             - F.make_dt_interval(secs=(F.col("doc_id") % 86400).cast("decimal(18,6)")))
            .alias("timestamp"),
        )
        pages = self.table("pages").select(
            *self._placed("pages-topic", k="page_id"), F.col("url").alias("key"),
            F.col("html").alias("value"), none, at,
        )
        turns = self.table("conversations").select(
            F.lit("conversations-topic").alias("topic"),
            (F.col("conv_id") % 3).cast("int").alias("partition"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("offset"),
            F.col("conv_id").cast("string").alias("key"), F.col("text").alias("value"), none, at,
        )
        return docs.unionByName(pages).unionByName(turns)

    # ---- typed events ------------------------------------------------------------

    def order_events(self) -> DataFrame:
        """Typed orders with one or two items; some break the constraints on purpose."""
        money = "decimal(18,2)"
        k, price = F.col("k"), F.col("o_totalprice").cast(money)
        quantity = F.when(_every(41, 0), 0).otherwise(k % 5 + 1).cast("int")
        freight = (k % 7).cast(money)
        items_total = (price * quantity).cast(money)

        def item(product: Column, name: Column, n: Column, unit: Column, total: Column) -> Column:
            return F.struct(product.alias("product_id"), name.alias("product_name"), n.alias("quantity"),
                            unit.alias("unit_price"), total.alias("total_price"))

        basket = item(_text("P", k % 2000), _text("part ", k % 2000), quantity, price, items_total)
        shipping = item(F.lit("FREIGHT"), F.lit("freight"), F.lit(1), freight, freight)
        both = F.array_compact(F.array(F.when(~_every(43, 0), basket), F.when(_every(3, 0), shipping)))
        added = F.when(_every(43, 0), F.lit(0)).otherwise(items_total) + F.when(
            _every(3, 0), freight).otherwise(F.lit(0))
        return self.table("orders").withColumnRenamed("o_orderkey", "k").select(
            "k",
            F.when(_every(47, 0), " ").otherwise(_text("ORD-", k)).alias("order_id"),
            _text("CUST-", F.col("o_custkey")).alias("customer_id"),
            F.when(_every(25, 1), F.lit(None).cast("string"))
            .when(F.col("o_orderstatus") == "P", "PENDING")
            .when(F.col("o_orderstatus") == "O", "CONFIRMED")
            .when(_every(53, 2), "LOST").otherwise("DELIVERED").alias("status"),
            both.alias("items"),
            F.when(_every(4, 0), price).otherwise(added).cast(money).alias("total_amount"),
            F.col("o_orderdate").alias("order_timestamp"),
        )

    def payment_events(self) -> DataFrame:
        states = F.array(*[F.lit(s) for s in (
            "PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED", "REFUNDED",
            "PARTIALLY_REFUNDED")])
        return self.table("orders").withColumnRenamed("o_orderkey", "k").select(
            "k",
            _text("PAY-", F.col("k")).alias("payment_id"),
            F.when(_every(47, 0), "").otherwise(_text("ORD-", F.col("k"))).alias("order_id"),
            _text("CUST-", F.col("o_custkey")).alias("customer_id"),
            F.element_at(states, (F.col("k") % 7 + 1).cast("int")).alias("status"),
            F.when(_every(30, 0), F.lit(0)).otherwise(F.col("o_totalprice"))
            .cast("decimal(18,2)").alias("amount"),
            F.when(_every(61, 0), "\t").otherwise("USD").alias("currency"),
            F.when(~_every(59, 0), F.struct(
                F.when(~_every(31, 0), "CREDIT_CARD").alias("type"))).alias("payment_method"),
            F.col("o_orderdate").alias("payment_timestamp"),
        )

    # ---- failures ----------------------------------------------------------------

    def _failure_rows(self) -> DataFrame:
        k = F.col("k")
        kind = k % 6
        topics = F.array(*[F.lit(t) for t in (
            "orders-topic", "payments-topic", "notifications-topic")])
        codes = F.array(*[F.lit(c) for c in (
            "AUTH_FAILED", "ACCESS_DENIED", "CONFIG_ERROR", "UNKNOWN")])
        services = F.array(F.lit("Inventory"), F.lit("payment-gateway"), F.lit("mail"),
                           F.lit(None).cast("string"))
        classes = F.array(*[F.lit(c) for c in (
            "ValidationException", "ValidationException", "NonRecoverableException",
            "RecoverableException", "DeserializationException", "IllegalStateException")])
        return self._event_rows().select(
            "k",
            F.element_at(topics, (k % 3 + 1).cast("int")).alias("topic"),
            (F.expr("k div 3") % 3).cast("int").alias("partition"),
            F.expr("k div 9").alias("offset"),
            _text("user-", F.col("user_id")).alias("key"),
            F.col("props").alias("value"),
            no_headers().alias("headers"),
            "timestamp",
            F.element_at(classes, (kind + 1).cast("int")).alias("exception_class"),
            _text("failure of ", k).alias("exception_message"),
            F.when(kind == 2, F.element_at(codes, (k % 4 + 1).cast("int"))).alias("error_code"),
            F.when(kind == 3, F.element_at(services, (F.col("user_id") % 4 + 1).cast("int")))
            .alias("service_name"),
            F.when(kind == 0, "Amount").alias("field_name"),
            F.when(kind == 0, "NON_EMPTY_ORDER").alias("validation_rule"),
            F.when(k % 8 != 0, _text("corr-", k)).alias("correlation_id"),
            (k % 5 + 1).cast("int").alias("attempts"),
        )

    def failures(self) -> DataFrame:
        """One row per failed attempt, 30 seconds apart."""
        rows = self._failure_rows()
        gap = F.make_dt_interval(secs=((F.col("attempt") - 1) * 30).cast("decimal(18,6)"))
        return (
            rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("attempts"))))
            .withColumn("failed_at", F.col("timestamp") + gap)
            .drop("attempts", "k")
        )

    def exhausted(self) -> DataFrame:
        """The last attempt of each failed record: what goes to a dead-letter log."""
        gap = F.make_dt_interval(secs=((F.col("attempts") - 1) * 30).cast("decimal(18,6)"))
        return (
            self._failure_rows()
            .withColumn("failed_at", F.col("timestamp") + gap)
            .withColumnRenamed("attempts", "attempt").drop("k")
        )

    # ---- snapshots ---------------------------------------------------------------

    def offsets(self) -> DataFrame:
        """Daily positions of fifty consumer groups: the last record of their users against
        the end of the log. Group 0 claims to be ahead of the log."""
        log = self._event_rows().select(
            F.concat(F.lit("group-"), (F.col("user_id") % 50).cast("string")).alias("group"),
            F.lit("notifications-topic").alias("topic"),
            (F.col("k") % 3).cast("int").alias("partition"),
            F.expr("k div 3").alias("offset"),
            F.date_trunc("day", F.col("timestamp")).alias("ts"),
        )
        place = ["topic", "partition", "ts"]
        seen = log.groupBy("group", *place).agg((F.max("offset") + 1).alias("committed"))
        ends = seen.groupBy(*place).agg(F.max("committed").alias("end_offset"))
        committed = F.when(F.col("group") == "group-0", F.col("committed") + 500).otherwise(
            F.col("committed"))
        return seen.join(ends, place).select(
            "group", "topic", "partition", committed.alias("committed"), "end_offset", "ts"
        )

    def members(self) -> DataFrame:
        """Daily membership: users active in an event type are the consumers of that group."""
        return self._event_rows().groupBy(
            F.col("event_type").alias("group"),
            F.date_trunc("day", F.col("timestamp")).alias("ts"),
            _text("user-", F.col("user_id")).alias("consumer_id"),
        ).agg(F.count(F.lit(1)).cast("int").alias("partitions"))

    def metrics(self) -> DataFrame:
        """A utilization series per event type, from the event values."""
        return self._event_rows().select(
            F.lit("utilization").alias("name"),
            F.create_map(F.lit("stage"), F.col("event_type")).alias("tags"),
            F.col("timestamp").alias("ts"), (F.col("value") / 50).alias("value"),
            F.col("event_type").alias("stage"), F.col("k").alias("seq"),
        )

    def calls(self) -> DataFrame:
        """Outcomes of calls per user, for the breaker."""
        return self._event_rows().select(
            _text("user-", F.col("user_id")).alias("key"), F.col("timestamp").alias("ts"),
            F.col("k").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        )

    # ---- work allocation -----------------------------------------------------------

    def owners(self) -> DataFrame:
        """Suppliers as workers, each subscribed to all three queues."""
        k = F.col("s_suppkey")
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        levels = F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW"))
        return self.table("supplier").join(
            places, F.col("s_nationkey") == F.col("n_nationkey"), "left"
        ).select(
            F.explode(F.array(F.lit("batch-parts"), F.lit("stream-parts"), F.lit("bulk-parts")))
            .alias("queue"),
            _text("S", F.lpad(k.cast("string"), 12, "0")).alias("owner"),
            _text("rack-", F.col("s_nationkey") % 5).alias("rack"),
            F.element_at(levels, (k % 3 + 1).cast("int")).alias("priority"),
            (k % 97 + 1).cast("int").alias("capacity"),
            F.coalesce("r_name", F.lit("none")).alias("region"),
            F.array_compact(F.array(F.when(k % 2 == 0, "BATCH_PROCESSING"),
                                    F.when(k % 3 == 0, "REAL_TIME"))).alias("capabilities"),
            F.array_compact(F.array(F.when(k % 5 == 0, "HIGH_THROUGHPUT"))).alias("preferences"),
        )

    def units(self) -> DataFrame:
        """Parts as units of work in three queues; two of seven racks have no worker."""
        k = F.col("p_partkey")
        queues = F.array(F.lit("batch-parts"), F.lit("stream-parts"), F.lit("bulk-parts"))
        return self.table("part").select(
            F.element_at(queues, (F.col("p_size") % 3 + 1).cast("int")).alias("queue"),
            k.alias("unit"), _text("rack-", k % 7).alias("rack"),
            F.when(k % 4 != 0, _text("S", F.lpad(((k * 7) % 1000).cast("string"), 12, "0")))
            .alias("previous_owner"),
        )
