"""Chat exports: nested JSON in, one row a message out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import pseudonym
from quillmark.sources import ranges

ENTITY = "array<struct<type:string,text:string>>"
MESSAGE = f"struct<id:bigint,type:string,date_unixtime:string,`from`:string,from_id:string,text_entities:{ENTITY},forwarded_from:string,saved_from:string,via_bot:string,reply_to_message_id:bigint>"
CHAT = f"struct<id:bigint,name:string,type:string,messages:array<{MESSAGE}>>"
#: The field `text`, a string or a list, is left out: entities hold the same.
EXPORT = f"chats struct<list:array<{CHAT}>>, left_chats struct<list:array<{CHAT}>>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Chats in export order (section, chat_no, chat fields). A malformed file is an error.

    One document is one task. `read_by_ranges` spreads it; `read_chats` reads exports with one chat a line."""
    dump = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    one = lambda k, name: dump.select(F.lit(k).alias("section"), F.posexplode(f"{name}.list").alias("chat_no", "chat"))
    return one(0, "chats").unionByName(one(1, "left_chats")).select("section", "chat_no", "chat.*")


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Chats written one a line, each with its section and chat_no."""
    fields = CHAT.removeprefix("struct<").removesuffix(">").replace("id:bigint,name:string,type:string,messages:", "id bigint, name string, type string, messages ")
    return spark.read.schema(f"section int, chat_no int, {fields}").option("mode", "FAILFAST").json(path)


def register_of(kind) -> F.Column:
    return F.when(kind.isin("personal_chat", "saved_messages"), "dm").otherwise("group")


def without_stopped(chats: DataFrame, stop_list: tuple[str, ...]) -> DataFrame:
    """Leaves out chats by exact name, in any case."""
    return chats.where(~F.coalesce(F.lower("name").isin([n.lower() for n in stop_list]), F.lit(False))) if stop_list else chats


def read_by_ranges(spark: SparkSession, path: str, size: int = ranges.RANGE) -> DataFrame:
    """Messages of one export document of any size, one a row, for `shaped`."""
    rows = ranges.read_messages(spark, path, size)
    return rows.withColumn("m", F.from_json("raw", MESSAGE, {"mode": "FAILFAST"})).drop("raw")


def messages(chats: DataFrame) -> DataFrame:
    """Messages of chats that hold theirs as an array, as `shaped` gives them."""
    return shaped(chats.select("section", "chat_no", "id", "name", "type", F.posexplode("messages").alias("pos", "m")))


def shaped(rows: DataFrame) -> DataFrame:
    """section, chat_no, pos, chat_key, chat_type, register, id, ts, sender, from_id, text, entities,
    is_forwarded, is_via_bot, n_links, reply_to: entries of type `message`, in export order by pos."""
    rows = rows.select("section", "chat_no", pseudonym("chat", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("name", F.lit("")))).alias("chat_key"), F.col("type").alias("chat_type"), register_of(F.col("type")).alias("register"), "pos", "m")
    entities = F.transform(F.filter("m.text_entities", lambda e: F.coalesce(e["text"], F.lit("")) != ""), lambda e: F.struct(F.coalesce(e["type"], F.lit("plain")).alias("type"), e["text"].alias("text")))
    rows = rows.where(F.col("m.type") == "message").withColumn("entities", F.coalesce(entities, F.array().cast(ENTITY)))
    return rows.select(
        "section", "chat_no", "pos", "chat_key", "chat_type", "register", "m.id",
        F.coalesce(F.expr("try_cast(m.date_unixtime as bigint)"), F.lit(0).cast("long")).alias("ts"),
        F.coalesce("m.from", F.lit("")).alias("sender"),
        F.coalesce("m.from_id", F.lit("")).alias("from_id"),
        F.array_join(F.transform("entities", lambda e: e["text"]), "").alias("text"),
        "entities",
        (F.coalesce("m.forwarded_from", "m.saved_from").isNotNull()).alias("is_forwarded"),
        F.col("m.via_bot").isNotNull().alias("is_via_bot"),
        F.size(F.filter("entities", lambda e: e["type"].isin("link", "text_link"))).alias("n_links"),
        F.col("m.reply_to_message_id").alias("reply_to"),
    )


def owner_of(rows: DataFrame) -> DataFrame:
    """from_id: the sender of the first saved message, else the most frequent sender, the earlier first
    among equals. One row; none for an empty table."""
    place = F.struct("section", "chat_no", "pos")
    per = rows.where("from_id <> ''").groupBy("from_id").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min(F.when(F.col("chat_type") == "saved_messages", place)).alias("saved"))
    return per.orderBy(F.asc_nulls_last("saved"), F.desc("n"), "first").limit(1).select("from_id")
