"""Send queue, templates, rendering, and folding outcome events into current state."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.functions.text import list_items
from firmweave.functions.times import at, plus
from firmweave.session import lookup_join


def due_send_queue(
    links: DataFrame, leads: DataFrame, campaign_id: int, now, n: int | None = None,
    prioritize_tier: bool = True, prioritize_score: bool = True,
) -> DataFrame:
    """The links to send: running, due, lead not suppressed. With n the first n of them in order, a distributed top-n."""
    open_links = links.where(
        (F.col("campaign_id") == campaign_id)
        & F.col("stopped_reason").isNull()
        & (F.col("next_send_at").isNull() | (F.col("next_send_at") <= at(now)))
    )
    usable = leads.where(F.col("status") != "do_not_contact").withColumnsRenamed({"id": "_lead", "status": "lead_status"})
    clash = [c for c in usable.columns if c in open_links.columns]
    joined = open_links.join(usable.drop(*clash), F.col("lead_id") == F.col("_lead")).drop("_lead")
    if n is None:
        return joined
    order = [F.col("tier").asc_nulls_last()] if prioritize_tier else []
    order += [F.col("score").desc_nulls_last()] if prioritize_score else []
    return joined.orderBy(*order, F.col("next_send_at").asc_nulls_first(), F.col("id").asc()).limit(n)


def template_pick(queue: DataFrame, campaign_templates: DataFrame) -> DataFrame:
    """Adds template_id and variant: the preferred variant if the step has it, else the first by name.

    Rows whose step has no template keep NULL, so the caller sees them.
    """
    # Every row of a campaign shares its few steps, so these are lookups with hot keys.
    exact = campaign_templates.groupBy("campaign_id", F.col("step").alias("_step"), F.col("variant").alias("current_variant")).agg(
        F.max("template_id").alias("_exact")
    )
    first = campaign_templates.groupBy("campaign_id", F.col("step").alias("_step")).agg(
        F.min(F.struct("variant", "template_id")).alias("_first")
    )
    step = queue.withColumn("_step", F.coalesce("current_step", F.lit(1)))
    step = lookup_join(step, exact, ["campaign_id", "_step", "current_variant"], ["lead_id"])
    step = lookup_join(step, first, ["campaign_id", "_step"], ["lead_id"])
    known = F.col("_exact").isNotNull()
    return step.withColumns(
        {
            "variant": F.when(known, F.col("current_variant")).otherwise(F.col("_first.variant")),
            "template_id": F.when(known, F.col("_exact")).otherwise(F.col("_first.template_id")),
        }
    ).select(*queue.columns, "variant", "template_id")


# Fixed value: the placeholder form, {{key}} or {{key | default:"text"}}.
PLACEHOLDER = r'\{\{\s*([a-zA-Z0-9_]+)\s*(?:\|\s*default\s*:\s*"([^"]*)")?\s*\}\}'


def render(text: Column, context: dict[str, Column]) -> Column:
    """Fill all placeholders in one pass (filled-in text is never searched again).

    A missing or NULL value gives the default, else nothing.
    """
    values = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), v.cast("string"))])
    # Each text part is followed by the placeholder after it; the last one by none.
    parts = F.split(text, PLACEHOLDER, -1)
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    keys = F.transform(found, lambda m: F.regexp_extract(m, PLACEHOLDER, 1))
    defaults = F.transform(found, lambda m: F.regexp_extract(m, PLACEHOLDER, 2))
    filled = F.zip_with(keys, defaults, lambda k, d: F.coalesce(F.try_element_at(values, k), d))
    pieces = F.zip_with(parts, filled, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    return F.array_join(pieces, "")


def primary_address(c: Column | str) -> Column:
    return F.get(list_items(c), F.lit(0))


def message_render(
    queue: DataFrame, templates: DataFrame, now, *, from_name: str = "", from_email: str = "", reply_to: str = "",
    signature_html: str = "", signature_text: str = "",
) -> DataFrame:
    """One queued message per queue row that has an address and a template."""
    bodies = templates.select(F.col("id").alias("template_id"), "subject", "body", F.lit(True).alias("_has"))
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    context = {
        "orgnr": F.col("orgnr"), "company_name": filled("company_name"), "city": filled("city"),
        "sni_codes": filled("sni_codes"), "website": filled("website"), "emails": filled("emails"),
        "contact_name": F.lit(""), "your_company": F.lit(from_name), "your_contact_info": F.lit(reply_to or from_email),
    }
    stamp = at(now)
    body = render(F.coalesce(F.col("body"), F.lit("")), context)
    signed = lambda sep, sig: F.concat(F.col("_body"), F.lit(sep + sig)) if sig else F.col("_body")
    addressed = queue.withColumn("to_email", primary_address("emails")).where(F.col("to_email").isNotNull())
    return (
        lookup_join(addressed, bodies, ["template_id"], ["lead_id"], max_rows=10_000)
        .where(F.col("_has"))
        .withColumn("_body", body)
        .select(
            "lead_id", "campaign_id", "template_id", F.coalesce("current_step", F.lit(1)).alias("step"), "variant", "to_email",
            F.lit(from_email).alias("from_email"),
            render(F.coalesce(F.col("subject"), F.lit("")), context).alias("subject_rendered"),
            signed("<br><br>", signature_html).alias("body_rendered"),
            signed("\n\n", signature_text).alias("text_rendered"),
            F.lit("queued").alias("status"), stamp.alias("scheduled_at"), F.lit(None).cast("timestamp").alias("sent_at"),
            F.lit(None).cast("string").alias("error"), stamp.alias("created_at"), stamp.alias("updated_at"),
        )
    )


def sequence_advance(links: DataFrame, sent: DataFrame, now, min_hours: int = 24) -> DataFrame:
    """Links with a message go one step on, keep the variant used and wait at least ``min_hours``.

    ``sent``: lead_id, campaign_id, step, variant.
    """
    key = ["lead_id", "campaign_id"]
    last = sent.groupBy(*key).agg(F.max(F.struct("step", "variant")).alias("_sent"))
    hit = F.col("_sent").isNotNull()
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    changes = {
        "current_step": put("current_step", F.col("_sent.step") + 1).cast("int"),
        "current_variant": put("current_variant", F.col("_sent.variant")),
        "next_send_at": put("next_send_at", plus(at(now), hours=min_hours)),
    }
    return links.join(last, key, "left").withColumns(changes).select(*links.columns)


OUTCOME_KEYS = ["level", "key", "campaign_id"]


def outcome_state(events: DataFrame) -> DataFrame:
    """Events (lead_id, campaign_id, message_id, type, reason, created_at, id) reduced by lead, link and message.

    A row (``level``, ``key``, ``campaign_id``) has the last word of its key, the first guarded reason, the last time of sending and the last error, each
    with its moment. These only compare moments, so states of any parts of a log merge to that of the whole (``merge_outcomes``).
    """
    kind = F.col("type")
    moment = lambda name, value, on: F.when(on, F.struct("created_at", "id", value.alias("value"))).alias(name)
    never = F.lit(None).cast("string")
    stop = kind.isin("complaint", "manual_stop")
    contacted = (kind == "sent") & F.col("message_id").isNull()
    status = F.when(stop | (kind == "bounce"), "do_not_contact").when(contacted, "contacted").when(kind.isin("booked", "won"), kind)
    over = F.when(kind == "bounce", "bounced").when(kind.isin("booked", "won"), kind)
    word = F.when(kind == "sent", "sent").when(kind == "failed", "failed").when(kind == "bounce", "bounced")
    no = F.lit(False)

    def row(level: str, key: str, campaign: Column, last: Column, first: Column, on: Column, sent: Column, failed: Column) -> Column:
        return F.when(F.col(key).isNotNull() & (last.isNotNull() | on), F.struct(
            F.lit(level).alias("level"), F.col(key).cast("bigint").alias("key"), campaign.cast("int").alias("campaign_id"),
            moment("last", last, last.isNotNull()), moment("first", first, on), F.when(sent, F.col("created_at")).alias("sent_at"), moment("error", F.col("reason"), failed),
        ))

    none = F.lit(None)
    rows = F.array_compact(F.array(
        row("lead", "lead_id", none, status, kind, stop, no, no),
        row("link", "lead_id", F.col("campaign_id"), over, F.lit("replied"), kind == "reply", no, no),
        row("message", "message_id", none, word, never, no, kind == "sent", word.isin("failed", "bounced")),
    ))
    return _reduced_outcomes(events.select(F.explode(rows).alias("r")).select("r.*"))


def _reduced_outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*OUTCOME_KEYS).agg(F.max("last").alias("last"), F.min("first").alias("first"), F.max("sent_at").alias("sent_at"), F.max("error").alias("error"))


def merge_outcomes(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state of both logs."""
    return _reduced_outcomes(state.unionByName(new))


def changed_outcomes(state: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of the merged state that new events touch; others of the stored state are only filtered, not reduced."""
    keys = new.select(*OUTCOME_KEYS)
    same = F.col("k.level").eqNullSafe(F.col("s.level")) & (F.col("k.key") == F.col("s.key")) & F.col("k.campaign_id").eqNullSafe(F.col("s.campaign_id"))
    return merge_outcomes(state.alias("s").join(keys.alias("k"), same, "left_semi"), new)


def apply_outcomes(leads: DataFrame, links: DataFrame, messages: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with what the state of the log says about their rows."""
    of = lambda level, *cols: state.where(F.col("level") == level).select(*cols)
    by_lead = of("lead", F.col("key").alias("lead_id"), F.col("last.value").alias("_status"), F.col("first").alias("_guard"))
    new_leads = (
        leads.join(by_lead.select(F.col("lead_id").alias("id"), "_status"), "id", "left")
        .withColumn("status", F.coalesce("_status", "status")).select(*leads.columns)
    )
    by_link = of("link", F.col("key").alias("lead_id"), "campaign_id", F.col("last.value").alias("_over"), F.col("first").alias("_reply"))
    # least() skips NULLs, so this is the earlier of the two guarded reasons.
    guarded = F.least("_reply", "_guard")["value"]
    new_links = (
        links.join(by_link, ["lead_id", "campaign_id"], "left").join(by_lead.select("lead_id", "_guard"), "lead_id", "left")
        .withColumn("stopped_reason", F.coalesce(F.col("_over"), F.col("stopped_reason"), guarded)).select(*links.columns)
    )
    by_message = of("message", F.col("key").alias("id"), F.col("last.value").alias("_status"), F.col("sent_at").alias("_sent_at"), F.col("error").alias("_err"))
    new_messages = messages.join(by_message, "id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"), "sent_at": F.coalesce("_sent_at", "sent_at"),
            "error": F.when(F.col("_err").isNotNull(), F.col("_err.value")).otherwise(F.col("error")),
        }
    ).select(*messages.columns)
    return new_leads, new_links, new_messages


def outcome_fold(
    leads: DataFrame, links: DataFrame, messages: DataFrame, events: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold an event log into the three tables: closed form of replaying it by time, one shuffle with map-side combine for all three."""
    return apply_outcomes(leads, links, messages, outcome_state(events))


def sequence_catalog(templates: DataFrame, audiences: Sequence[str] = ("supplier", "customer")) -> DataFrame:
    """Templates (id, name = ``email_<path>``, audience) -> campaign, step, variant, template; last one wins.

    Review mails belong to no sequence. A follow-up's step is one more than the number in its file name.
    """
    path = F.lower(F.expr("substring(name, 7)"))
    stem = F.upper(F.regexp_extract("name", r"([^/]*?)(?:\.[^./]*)?$", 1))
    number = F.coalesce(
        F.regexp_extract(path, "fu([0-9]+)", 1).try_cast("int"),
        F.regexp_extract(path, r"_([0-9]+)\.[a-z]+$", 1).try_cast("int"),
        F.lit(1),
    )
    step = (
        F.when(path.contains("_review/"), F.lit(None).cast("int"))
        .when(path.contains("_followup"), number + 1)
        .when(path.contains("_intro/"), F.lit(1))
    )
    letter = F.regexp_extract(stem, "(^|[^A-Z])(A|B|C)($|[^A-Z])", 2)
    known = templates.where(F.col("name").startswith("email_") & F.col("audience").isin(list(audiences)))
    rows = known.select(
        F.concat("audience", F.lit("_intro")).alias("campaign"), step.alias("step"),
        F.when(letter != "", letter).otherwise("A").alias("variant"), F.col("id").alias("template_id"), "name",
    ).where(F.col("step").isNotNull())
    return rows.groupBy("campaign", "step", "variant").agg(
        F.max("template_id").alias("template_id"), F.max_by("name", "template_id").alias("template_name")
    )


def sequence_coverage(catalog: DataFrame) -> DataFrame:
    """Per campaign: its steps in order and its number of templates."""
    steps = catalog.groupBy("campaign", "step").agg(F.count("*").alias("n"))
    return steps.groupBy("campaign").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("step")), lambda s: s.cast("string")), ",").alias("steps"),
        F.sum("n").alias("templates"),
    )
