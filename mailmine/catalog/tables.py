"""Reading the given tables, and the mail table derived from them.

The mail table is a projection of ``orders`` joined with ``customer``: one mail
per order, whole table. Its expressions run unchanged on Spark and on DuckDB,
so both sides of a check start from the same mails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.sources.mails import clean_rows
from mailmine.operators.prepare import prepare


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that is stored in fewer splits than the cluster has slots.

    A large table has far more splits than slots and passes through untouched.
    """

    slots = df.sparkSession.sparkContext.defaultParallelism
    if slots > 1 and df.rdd.getNumPartitions() < slots:
        return df.repartition(slots, key)
    return df


# the column a stored table is spread on
SPREAD_ON = {
    "orders": "o_orderkey", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
    "conversations": "conv_id",
}


MAIL_ROWS = 1 << 16   # mails of a task at most, about


def dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """Spread ``df``, with about so many ``rows``, over tasks of ``MAIL_ROWS``; as it is where the slots' tasks hold no more.

    After a join the planner makes tasks by the bytes of the narrow rows that were shuffled, few large ones; what
    the expressions on a row cost it does not know.
    """

    tasks = -(-rows // MAIL_ROWS)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.select(*columns) if columns else df
    return widen(df, SPREAD_ON[table]) if table in SPREAD_ON else df


_KEY = "CAST(o_orderkey AS VARCHAR(20))"
_INVOICE = f"'INV-' || lpad({_KEY}, 6, '0')"
_SLASH_DATE = (
    "CAST(extract(month FROM o_orderdate) AS VARCHAR(20)) || '/' || "
    "CAST(extract(day FROM o_orderdate) AS VARCHAR(20)) || '/' || "
    "CAST(extract(year FROM o_orderdate) AS VARCHAR(20))"
)


def _choose(number: str, texts: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    return f"CASE {number} % {len(texts)} {arms} END"


def _quoted(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


# the market segment as a name: first letter large, the rest small
_SEGMENT = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"
_ORDER = "'the ' || lower(c_mktsegment) || ' order'"

_SUBJECT = _choose(
    "o_orderkey",
    [
        f"'  Invoice ' || {_INVOICE} || ' for   ' || lower(c_mktsegment)",
        f"'Following up on ' || {_ORDER}",
        f"'Issue with ' || {_ORDER}",
        *_quoted("Thank you for your help", ""),
        f"'Meeting on Tuesday, availability for ' || {_ORDER}",
        f"'Our apologies regarding ' || {_ORDER}",
        f"'URGENT: ' || o_orderpriority",
        f"'Hello from ' || {_SEGMENT}",
        f"'RE: order ' || {_KEY} || ' due ' || {_SLASH_DATE}",
        f"'Announcement: news for ' || {_SEGMENT}",
    ],
)
_GREETING = _choose("o_orderkey", _quoted("Hi ", "Dear ", "hello ", "Hey ", "Greetings, ", "To "))
_NAME = f"{_SEGMENT} || CASE WHEN o_custkey % 5 = 2 THEN ' Team' ELSE '' END"
_MAIN = _choose(
    "o_orderkey",
    [
        f"'Please pay $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) || ',50 for ' || {_INVOICE} "
        f"|| ' by next week or ' || {_SLASH_DATE} || '. See https://pay.example.com/track?id=' || {_KEY} || ' now.'",
        "'Just checking in on your order. Could you confirm by Friday? Call +1 555-010-' "
        "|| lpad(CAST(o_custkey % 10000 AS VARCHAR(20)), 4, '0') || '.'",
        "'I am unhappy with the delay at Harbour Parts Inc and this is unacceptable. Reply to ops' "
        "|| CAST(o_custkey AS VARCHAR(20)) || '@example.com on October ' "
        "|| CAST(1 + o_orderkey % 28 AS VARCHAR(20)) || ', 2024.'",
        "'Thanks so much for the support. [image: logo] We really appreciate it.'",
        "'   '",
        "'Can we find a slot in the calendar by tomorrow? Details: https://docs.example.org/d/' || "
        f"{_KEY} || ' and https://click.example.net/u/' || {_KEY}",
        *_quoted("We regret the mistake. Please accept our apologies; the fix ships by end of month.",
                 "This is critical and time-sensitive; respond immediately or escalate by EOD.",
                 "Nice to meet you. I would like to introduce Millbrook Corp and suggest a call."),
        f"'Your request ' || {_KEY} || ' was received on March 3 and is complete.'",
        *_quoted("We are excited and pleased to announce the launch. Join us on Monday!"),
    ],
)
_EXTRA = _choose(
    "o_custkey",
    [
        "''",
        *_quoted("Let me know if you have any questions.", "I recommend you consider the new plan; I believe it is great.",
                 "btw thx, lol - cheers for the update", "Kindly review and verify the report today.",
                 "The result was terrible, awful and broken; a bad problem.",
                 "To whom it may concern: we look into the complaint.",
                 "Looking forward to it, this is amazing and perfect.",
                 "Any update on the follow up?", "The payment and the billing are attached.",
                 "I was happy, not angry; imagine a wonderful and fantastic day.",
                 "Sorry for the upset. We fail, we investigate, we resolve.",
                 "Yo team, ship out and deliver, then sign."),
    ],
)
_CLOSING = _choose(
    "o_custkey",
    _quoted("Best regards,", "thanks,", "Regards", "Best,", "KIND REGARDS,", "Yours faithfully,", "Cheers,"),
)
_SENDER = "CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open Orders' ELSE 'Pending' END"
_TAIL = _choose(
    "o_custkey",
    [
        "chr(10) || chr(10) || 'On Tue, Mar 5, 2024 at 10:00 AM, Bot wrote:' || chr(10) || '> old text' || chr(10) || chr(10)",
        "chr(10) || '-- ' || chr(10) || 'Sent from my iPhone'",
        "''",
        "chr(10) || 'Please unsubscribe here if you like'",
        "chr(10) || '----- Original Message -----' || chr(10) || 'From: Bot' || chr(10) || chr(10) || 'To: you' "
        "|| chr(10) || 'old line' || chr(10) || 'Sent from my phone'",
        "chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || 'P.S. all' || chr(9) || 'good'",
        "chr(10) || 'Confidentiality notice: private'",
    ],
)

# column name -> expression over orders JOIN customer
MAIL_COLUMNS = {
    "row_id": "o_orderkey",
    "email_id": f"'E' || {_KEY}",
    "subject": f"CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE {_SUBJECT} END",
    "body": (
        "CASE WHEN o_orderkey % 31 = 7 THEN NULL WHEN o_orderkey % 37 = 5 THEN ' ' || chr(10) ELSE "
        f"{_GREETING} || {_NAME} || ',' || chr(10) || chr(10) || chr(10) || {_MAIN} || ' ' || {_EXTRA} "
        f"|| chr(10) || chr(10) || {_CLOSING} || chr(10) || {_SENDER} || {_TAIL} END"
    ),
    "category": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE "
    + _choose(
        "o_orderkey",
        _quoted("invoice", "follow_up", "complaint", "thank_you", "general", "meeting_request",
                "apology", "urgent_request", "introduction", "confirmation", "announcement"),
    )
    + " END",
    "sentiment": "CAST(NULL AS VARCHAR(20))",
    "tone": "CASE WHEN o_custkey % 3 = 0 THEN 'formal' ELSE NULL END",
    "sender": _SENDER,
    "recipient": "c_name",
    "created_at": "o_orderdate",
}

# the plain CTE a DuckDB check starts from
MAILS_CTE = (
    "mails AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in MAIL_COLUMNS.items())
    + " FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail table with null and blank bodies, null subjects and CRLF tails."""

    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customer = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    joined = dealt(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), orders.count(), "o_orderkey")
    return joined.selectExpr(*[f"{e} AS {c}" for c, e in MAIL_COLUMNS.items()])


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail table after row cleaning."""

    return clean_rows(raw_mails(spark, sf_dir))


def prepared_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(mails(spark, sf_dir))
