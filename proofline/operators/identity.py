"""Who sent a submission: first message, agent registry, and unique links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import predicates as P
from proofline.functions.joins import first_by, lookup
from proofline.functions.text import chat_address, digits_key, phone_key

KEY = ["sender_identity", "application_id", "group_id", "sync_date"]


def join_extraction(files: DataFrame, extractions: DataFrame) -> DataFrame:
    """Finished, original files with their extraction."""
    kept = files.where(F.col("processing_status").isin(*K.FINISHED) & F.col("duplicate_of_id").isNull())
    return kept.join(extractions, "evidence_id")


def first_senders(messages: DataFrame) -> DataFrame:
    """Sender of the first message of each submission (it may be null)."""
    linked = messages.where(F.col("evidence_id").isNotNull())
    return first_by(linked, ["evidence_id"], ["message_date", "message_id"], ["sender_external_id"])


def join_sender(submissions: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds sender_external_id of the first message."""
    return submissions.join(first_senders(messages), "evidence_id", "left")


def origin_lookup(
    submissions: DataFrame, messages: DataFrame, channels: DataFrame, agents: DataFrame
) -> DataFrame:
    """Adds the first channel of each submission and its agent's name."""
    named = messages.where(F.col("evidence_id").isNotNull()).join(
        channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id"
    )
    first = first_by(
        named, ["evidence_id"], ["message_date", "message_id"], ["channel_id", "channel_name"]
    )
    people = agents.select("agent_id", F.col("full_name").alias("agent_name"))
    return lookup(submissions.join(first, "evidence_id", "left"), people, "agent_id", "evidence_id")


def agents_by_phone(agents: DataFrame) -> DataFrame:
    """Phones that belong to exactly one agent."""
    return (
        agents.select(phone_key(F.col("phone")).alias("phone"), "agent_id")
        .where(F.col("phone").isNotNull())
        .groupBy("phone").agg(F.count("*").alias("n"), F.min("agent_id").alias("agent_id"))
        .where("n = 1").drop("n")
    )


def agents_by_link(submissions: DataFrame, messages: DataFrame) -> DataFrame:
    """Chat addresses that belong to exactly one agent among identified submissions."""
    known = submissions.where(F.col("agent_id").isNotNull()).select("evidence_id", "agent_id")
    return (
        messages.where(F.col("sender_external_id").isNotNull())
        .join(known, "evidence_id")
        .groupBy(F.col("sender_external_id").alias("address"))
        .agg(F.min("agent_id").alias("agent_id"), F.max("agent_id").alias("other"))
        .where("agent_id = other").drop("other")
    )


def _identified(submissions: DataFrame, messages: DataFrame, agents: DataFrame) -> DataFrame:
    rows = join_sender(submissions, messages).withColumns({
        "sender_phone_key": phone_key(F.col("sender_phone")),
        "address": chat_address(F.col("sender_external_id")),
    })
    rows = rows.withColumn(
        "address", F.coalesce("address", F.concat("sender_phone_key", F.lit("@c.us")))
    ).withColumn("address_phone", F.nullif(F.regexp_extract("address", r"^(.*)@c\.us$", 1), F.lit("")))
    by_phone = agents_by_phone(agents)
    rows = lookup(
        rows, by_phone.select(F.col("phone").alias("address_phone"), F.col("agent_id").alias("phone_agent")),
        "address_phone", "evidence_id",
    )
    links = agents_by_link(submissions, messages)
    rows = lookup(
        rows, links.select("address", F.col("agent_id").alias("linked_agent")), "address", "evidence_id"
    )
    return rows.withColumn("sender_identity", F.coalesce(
        F.col("agent_id").cast("string"), F.col("phone_agent").cast("string"),
        F.col("linked_agent").cast("string"), F.col("address"),
    ))


def resolve_identity(submissions: DataFrame, messages: DataFrame, agents: DataFrame) -> DataFrame:
    """(evidence_id, sender_identity): the agent when one and only one fits, else the chat address."""
    return _identified(submissions, messages, agents).select("evidence_id", "sender_identity")


def resolve_agent(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds agent_id to messages by phone digits; a number shared by agents resolves to none."""
    unique = (
        agents.select(F.regexp_replace("phone", r"\D", "").alias("digits"), "agent_id")
        .where(F.col("digits").isNotNull())
        .groupBy("digits").agg(F.count("*").alias("n"), F.min("agent_id").alias("agent_id"))
        .where("n = 1").drop("n")
    )
    rows = messages.drop("agent_id").withColumn("digits", digits_key(F.col("sender_phone")))
    return lookup(rows, unique, "digits", "message_id")


def evidence_view(
    submissions: DataFrame, messages: DataFrame, agents: DataFrame, applications: DataFrame
) -> DataFrame:
    """One row per submission with identity, agent, state, day and reason.

    `submissions` has agent_id and sender_name next to the submission schema.
    """
    rows = _identified(submissions, messages, agents)
    by_phone = agents_by_phone(agents).select(
        F.col("phone").alias("sender_phone_key"), F.col("agent_id").alias("own_phone_agent")
    )
    rows = lookup(rows, by_phone, "sender_phone_key", "evidence_id").withColumn(
        "person", F.coalesce(
            F.col("agent_id").cast("string"), F.col("own_phone_agent").cast("string"),
            F.col("sender_identity"),
        )
    )
    people = agents.select(
        F.col("agent_id").cast("string").alias("person"), F.col("agent_id").alias("person_id"),
        F.col("full_name").alias("person_name"), "locality",
    )
    rows = lookup(rows, people, "person", "evidence_id")
    names = applications.select("application_id", F.col("name").alias("application_name"))
    rows = lookup(rows, names, "application_id", "evidence_id")
    day, basis = P.day_columns()
    return rows.select(
        "evidence_id",
        F.col("person_id").alias("agent_id"),
        F.coalesce("person_name", "sender_name", F.lit(K.UNKNOWN_AGENT)).alias("agent"),
        F.when(F.col("person_id").isNotNull(), "registry").otherwise("sender_unverified")
        .alias("identity_source"),
        "locality",
        "application_id",
        F.coalesce("application_name", F.lit(K.UNKNOWN_APPLICATION)).alias("application"),
        F.col("group_id").alias("group"),
        day.alias("date"),
        basis.alias("date_basis"),
        "received_at",
        P.state().alias("status"),
        F.coalesce("sync_status", F.lit("UNCONFIRMED")).alias("sync_status"),
        "processing_status",
        "sender_identity",
        F.coalesce("requires_review", F.lit(True)).alias("requires_review"),
        P.reason().alias("review_reason"),
        F.col("sync_date").alias("detected_date"),
        F.coalesce("date_is_ambiguous", F.lit(True)).alias("date_is_ambiguous"),
        "confidence",
        "duplicate_of_id",
    )


def has_report_key(alias: str | None = None):
    """Sender, application, group and an unambiguous date are all known."""
    c = (lambda name: F.col(f"{alias}.{name}")) if alias else F.col
    known = F.lit(True)
    for name in KEY:
        known = known & F.coalesce(c(name).cast("string") != "", F.lit(False))
    return known & ~F.coalesce(c("date_is_ambiguous"), F.lit(True))


def report_key():
    """The report key as one text column, null unless complete."""
    return F.when(has_report_key(), F.concat_ws("\u0001", *KEY))
