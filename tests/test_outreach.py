import random

from pyspark.sql import functions as F

from firmweave.operators import outreach as out

NOW = "2024-01-31 00:00:00"
LINKS = "id int, lead_id int, campaign_id int, current_step int, current_variant string, next_send_at string, stopped_reason string, tier int, score int"


def links(spark, *items):
    return spark.createDataFrame(list(items), LINKS).withColumn("next_send_at", F.col("next_send_at").cast("timestamp"))


def leads(spark, *items):
    return spark.createDataFrame(list(items), "id int, orgnr string, company_name string, city string, sni_codes string, website string, emails string, status string")


def test_due_queue_order(spark):
    ls = links(
        spark, (1, 1, 1, 1, None, None, None, None, 999), (2, 2, 1, 1, None, "2024-01-01", None, 2, 10), (3, 3, 1, 1, None, "2024-01-02", None, 1, 10), (4, 4, 1, 1, None, "2024-01-01", None, 1, 10),
        (5, 5, 1, 1, None, None, None, 1, 20), (6, 6, 1, 1, None, "2025-01-01", None, 1, 99), (7, 7, 1, 1, None, None, "replied", 1, 99), (8, 8, 1, 1, None, None, None, 1, 99), (9, 9, 1, 1, None, None, None, 1, 99), (10, 1, 2, 1, None, None, None, 1, 99),
    )
    people = leads(spark, *[(i, str(i), "c", "", "", "", "a@b.se", {8: None, 9: "do_not_contact"}.get(i, "new")) for i in range(1, 10)])
    ids = lambda **kw: [r.id for r in out.due_send_queue(ls, people, 1, NOW, 10, **kw).collect()]
    assert ids() == [5, 4, 3, 2, 1]
    assert ids(prioritize_tier=False) == [1, 5, 2, 4, 3]
    assert ids(prioritize_tier=False, prioritize_score=False) == [1, 5, 2, 4, 3]
    assert len(out.due_send_queue(ls, people, 1, NOW, 2).collect()) == 2


def test_template_pick(spark):
    ct = spark.createDataFrame([(1, 1, "B", 2), (1, 1, "A", 1), (1, 2, "C", 3)], "campaign_id int, step int, variant string, template_id int")
    ls = links(spark, (1, 1, 1, 1, "B", None, None, 1, 1), (2, 1, 1, 1, "Z", None, None, 1, 1), (3, 1, 1, None, None, None, None, 1, 1), (4, 1, 1, 2, "A", None, None, 1, 1), (5, 1, 1, 9, "A", None, None, 1, 1))
    got = {r.id: (r.variant, r.template_id) for r in out.template_pick(ls, ct).collect()}
    assert got == {1: ("B", 2), 2: ("A", 1), 3: ("A", 1), 4: ("C", 3), 5: (None, None)}


def test_render(spark):
    ctx = {"a": F.lit("{{b}}"), "b": F.lit("B"), "empty": F.lit(""), "none": F.lit(None)}
    cases = {
        "{{a}}-{{ b }}": "{{b}}-B", '{{x | default:"d"}}{{x}}{{none|default:"n"}}': "dn", '{{empty | default:"d"}}!': "!", "no { {b}}": "no { {b}}", "": "", "{{b}}": "B",
        '{{b | default:"z"}} costs $1 \\ {{b}}': "B costs $1 \\ B",
    }
    for text, want in cases.items():
        assert spark.createDataFrame([(text,)], "t string").select(out.render(F.col("t"), ctx)).first()[0] == want, text


def test_messages_and_advance(spark):
    queue = spark.createDataFrame(
        [(1, 1, 1, None, "A", 5, "o", "Co", None, None, None, '["x@y.se","z@y.se"]'), (2, 1, 2, "A", "A", 5, "o", "Co", "Lund", None, None, " "), (3, 1, 1, None, None, None, "o", "C", "L", None, None, "a@b.se")],
        "lead_id int, campaign_id int, current_step int, current_variant string, variant string, template_id int, orgnr string, company_name string, city string, sni_codes string, website string, emails string",
    )
    templates = spark.createDataFrame([(5, "Hi {{company_name}}", "{{city}}|{{your_contact_info}}")], "id int, subject string, body string")
    got = out.message_render(queue, templates, NOW, from_email="me@x.se", reply_to="re@x.se", signature_html="S", signature_text="S").collect()
    assert len(got) == 1
    m = got[0]
    assert (m.lead_id, m.to_email, m.subject_rendered, m.body_rendered, m.text_rendered, m.status, m.step) == (1, "x@y.se", "Hi Co", "|re@x.se<br><br>S", "|re@x.se\n\nS", "queued", 1)
    ls = links(spark, (1, 1, 1, 1, None, None, None, 1, 1), (2, 2, 1, 4, "B", "2024-01-01", None, 1, 1))
    sent = spark.createDataFrame([(1, 1, 1, "A")], "lead_id int, campaign_id int, step int, variant string")
    after = {r.id: (r.current_step, r.current_variant, str(r.next_send_at)) for r in out.sequence_advance(ls, sent, NOW).collect()}
    assert after == {1: (2, "A", "2024-02-01 00:00:00"), 2: (4, "B", "2024-01-01 00:00:00")}


def replay(lead_rows, link_rows, message_rows, events):
    """The event rules, one event at a time."""
    status, stop = dict(lead_rows), {k: v for k, v in link_rows}
    msg = {k: list(v) for k, v in message_rows}
    for e in sorted(events, key=lambda e: (e["created_at"], e["id"])):
        kind, lead, link, mid = e["type"], e["lead_id"], (e["lead_id"], e["campaign_id"]), e["message_id"]
        guarded = {"complaint": [k for k in stop if k[0] == lead], "manual_stop": [k for k in stop if k[0] == lead], "reply": [link]}
        if kind in guarded:
            for k in guarded[kind]:
                if k in stop and stop[k] is None:
                    stop[k] = "replied" if kind == "reply" else kind
        if kind in ("bounce", "booked", "won") and link in stop:
            stop[link] = "bounced" if kind == "bounce" else kind
        new = {"bounce": "do_not_contact", "complaint": "do_not_contact", "manual_stop": "do_not_contact", "booked": "booked", "won": "won"}.get(kind)
        if kind == "sent" and mid is None:
            new = "contacted"
        if new and lead in status:
            status[lead] = new
        if mid in msg and kind in ("sent", "failed", "bounce"):
            msg[mid][0] = "bounced" if kind == "bounce" else kind
            if kind == "sent":
                msg[mid][1] = e["created_at"]
            else:
                msg[mid][2] = e["reason"]
    return status, stop, {k: tuple(v) for k, v in msg.items()}


def test_fold_equals_replay(spark):
    kinds = ["sent", "failed", "bounce", "complaint", "manual_stop", "reply", "booked", "won", "delivered"]
    for seed in range(4):
        rng = random.Random(seed)
        events = [
            dict(id=i, lead_id=0 if rng.random() < 0.3 else rng.randrange(8), campaign_id=rng.choice([1, 2, None]), message_id=rng.choice([None, rng.randrange(10)]), type=rng.choice(kinds), reason=f"r{i}",
                 created_at=f"2024-01-{rng.randrange(1, 9):02d} 00:00:00")
            for i in range(60)
        ]
        lead_rows = [(i, rng.choice(["new", None, "won"])) for i in range(8)]
        link_rows = [((i, c), rng.choice([None, None, "old"])) for i in range(8) for c in (1, 2)]
        message_rows = [(i, ("queued", None, None)) for i in range(10)]
        ev = spark.createDataFrame(events, "id int, lead_id int, campaign_id int, message_id int, type string, reason string, created_at string")
        a, b, c = out.outcome_fold(
            spark.createDataFrame(lead_rows, "id int, status string"),
            spark.createDataFrame([(*k, v) for k, v in link_rows], "lead_id int, campaign_id int, stopped_reason string"),
            spark.createDataFrame([(k, *v) for k, v in message_rows], "id int, status string, sent_at string, error string"), ev,
        )
        status, stop, msg = replay(lead_rows, link_rows, message_rows, events)
        assert {r.id: r.status for r in a.collect()} == status
        assert {(r.lead_id, r.campaign_id): r.stopped_reason for r in b.collect()} == stop
        assert {r.id: (r.status, r.sent_at, r.error) for r in c.collect()} == msg


def test_catalog(spark, rows):
    paths = [
        (1, "email_customer_intro/intro_a.html", "customer"), (2, "email_customer_intro/intro_a.txt", "customer"), (3, "email_customer_intro/B.html", "customer"),
        (4, "email_customer_followup_intro/followup_intro_1.html", "customer"), (5, "email_customer_followup_intro/followup_intro_2.html", "customer"), (6, "email_supplier_followup/FU2.html", "supplier"),
        (7, "email_supplier_followup/again.html", "supplier"), (8, "email_customer_review/review.html", "customer"), (9, "email_customer_followup_review/x.html", "customer"), (10, "sig", "customer"),
        (11, "email_customer_intro/C.html", "other"), (12, "email_supplier_contract/x.html", "supplier"),
    ]
    cat = out.sequence_catalog(spark.createDataFrame(paths, "id int, name string, audience string"))
    assert rows(cat, "campaign", "step", "variant", "template_id") == [
        ("customer_intro", 1, "A", 2), ("customer_intro", 1, "B", 3), ("customer_intro", 2, "A", 4), ("customer_intro", 3, "A", 5), ("supplier_intro", 2, "A", 7), ("supplier_intro", 3, "A", 6)]
    assert rows(out.sequence_coverage(cat)) == [("customer_intro", "1,2,3", 4), ("supplier_intro", "2,3", 2)]


def test_states_of_any_parts_merge_to_that_of_all(spark, rows):
    kinds = ["sent", "failed", "bounce", "complaint", "manual_stop", "reply", "booked", "won", "delivered"]
    for seed in range(3):
        rng = random.Random(100 + seed)
        events = spark.createDataFrame(
            [(i, rng.randrange(6), rng.choice([1, 2, None]), rng.choice([None, rng.randrange(8)]), rng.choice(kinds), f"r{i}", f"2024-01-{rng.randrange(1, 9):02d} 00:00:00", rng.randrange(3)) for i in range(80)],
            "id int, lead_id int, campaign_id int, message_id int, type string, reason string, created_at string, part int")
        whole = rows(out.outcome_state(events))
        parts = [out.outcome_state(events.where(F.col("part") == p)) for p in range(3)]
        for a, b, c in ((0, 1, 2), (2, 0, 1)):
            assert rows(out.merge_outcomes(out.merge_outcomes(parts[a], parts[b]), parts[c])) == whole
        assert rows(out.merge_outcomes(parts[0], parts[0])) == rows(parts[0])
        changed = out.changed_outcomes(parts[0], parts[1])
        assert changed.count() == parts[1].count() and set(rows(changed)) <= set(rows(out.merge_outcomes(parts[0], parts[1])))
