"""Queries of the rules and operators for what one step hands on, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import handoff as rules
from ..operators import handoff
from ..session import table
from .registry import query

EVENT = "event_id % 7 AS a, event_id % 5 AS b, event_id % 11 AS c"


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.withColumns({n: F.col("event_id") % m for n, m in (("a", 7), ("b", 5), ("c", 11))})


def pick(column, *values):
    """One of some values by a number; null beyond them."""
    return F.get(F.array(*(F.lit(v) for v in values)), column.cast("int"))


def pick_sql(column, *values):
    return "CASE " + column + " " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


STATES = ["VERIFIED_CHALLENGE", " verified_challenge ", "UNRESOLVED", "REJECTED", None, "X", "PENDING_HUMAN_CONFIRMATION"]
SCOPES = ["MECHANISM", "scope", "ELSEWHERE", "", None]
VERIFIED = ["VERIFIED", "PENDING", "rejected", None, None, None, None, "UNVERIFIED", None, "", "OK"]
FAULT = f"""f AS (SELECT event_id, a, upper(trim(coalesce({pick_sql('a', *STATES)}, ''))) AS st, upper(trim(coalesce({pick_sql('b', *SCOPES)}, ''))) AS sc, upper(trim(coalesce({pick_sql('c', *VERIFIED)}, ''))) AS v, event_type FROM (SELECT event_id, event_type, {EVENT} FROM events)),
    g AS (SELECT *, CASE WHEN st = 'VERIFIED_CHALLENGE' AND v IN ('UNVERIFIED', 'REJECTED', 'PENDING', 'PENDING_HUMAN_CONFIRMATION') THEN 'VERIFICATION_CONFLICT'
        WHEN st = 'VERIFIED_CHALLENGE' AND sc <> '' AND sc NOT IN ('MECHANISM', 'PREMISE', 'SCOPE', 'MAGNITUDE') THEN 'SCOPE_REJECTED' END AS fault FROM f)"""


def challenges(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "event_type", pick(F.col("a"), *STATES).alias("challenge_status"), pick(F.col("b"), *SCOPES).alias("challenge_scope"), pick(F.col("c"), *VERIFIED).alias("verification"))


@query(f"""WITH {FAULT} SELECT event_id, event_type = 'error' OR st IN ('VERIFIED_CHALLENGE', 'PENDING_HUMAN_CONFIRMATION', 'UNRESOLVED') AS is_challenge, fault FROM g""")
def challenge_faults(spark, sf_dir):
    c = challenges(spark, sf_dir)
    relation = F.when(F.col("event_type") == "error", "challenge ").otherwise("supports")
    fault = rules.challenge_fault(F.col("challenge_status"), F.col("challenge_scope"), F.col("verification"))
    return c.select("event_id", rules.is_challenge(relation, F.col("challenge_status")).alias("is_challenge"), fault.alias("fault"))


@query(f"""WITH {FAULT} SELECT coalesce(fault, CASE WHEN a = 0 THEN 'COUNTS' END, 'NOT_VERIFIED') AS outcome, count(*) AS challenges FROM g GROUP BY 1""")
def challenge_audit(spark, sf_dir):
    return handoff.challenge_audit(challenges(spark, sf_dir))


@query(f"""SELECT event_id, CASE WHEN c = 0 THEN 'DERIVED' WHEN b = 0 THEN 'REFERENCED' WHEN a = 0 THEN 'NOT_REPORTED' WHEN trim(event_type || '') = 'error' THEN 'NOT_REPORTED' ELSE 'EXPLICIT' END AS support_type FROM (SELECT event_id, event_type, {EVENT} FROM events)""")
def support_types(spark, sf_dir):
    quote = F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type"))
    role = F.when(F.col("b") == 0, "REFERENCED_WORK").otherwise("RESULT")
    return events(spark, sf_dir).select("event_id", rules.support_type(F.col("c") == 0, role, F.when(F.col("a") < 3, F.col("a") == 0), quote).alias("support_type"))


STATED = [None, None, " ", "support", None, None, None]
CLAIM_STATES = ["SUPPORTED", "CONTRADICTORY", "PARTIALLY_SUPPORTED", "AMBIGUOUS", None]
AGREEMENT = ["VERIFIED_SAME_PROPOSITION", "DIFFERENT_PROPOSITION", "UNRESOLVED"]


@query(f"""WITH m AS (SELECT event_id, a, event_id % 3 AS g, c, {pick_sql('b', *CLAIM_STATES)} AS st FROM (SELECT event_id, {EVENT} FROM events)),
    s AS (SELECT *, CASE st WHEN 'SUPPORTED' THEN 'SUPPORT' WHEN 'CONTRADICTORY' THEN 'REFUTE' WHEN 'PARTIALLY_SUPPORTED' THEN 'CONDITIONAL' ELSE 'NEUTRAL' END AS told FROM m)
    SELECT event_id, CASE WHEN a = 3 THEN 'SUPPORT' WHEN c < 8 AND g > 0 THEN 'NEUTRAL' ELSE told END AS stance,
        CASE WHEN a = 3 THEN 'AGENT_MAPPED' WHEN c < 8 THEN {pick_sql('g', *AGREEMENT)} ELSE 'UNRESOLVED' END AS mapping FROM s""")
def mapped_stances(spark, sf_dir):
    source = F.when(F.col("c") < 8, "a raises b")
    told = rules.mapped_stance(pick(F.col("a"), *STATED), source, F.lit("a raises b"), pick(F.col("event_id") % 3, *AGREEMENT), pick(F.col("b"), *CLAIM_STATES))
    return events(spark, sf_dir).select("event_id", told.alias("m")).select("event_id", "m.*")


ACCESS = ["gold", "Green", "closed", "OPENALEX_ERROR", None]
LEDGER = f"""l AS (SELECT event_id, user_id, CASE WHEN a < 4 AND c < 6 THEN CASE WHEN b = 1 THEN 'PREPRINT_AVAILABLE' ELSE 'OA_DOWNLOADED' END WHEN a < 4 THEN CASE WHEN b < 2 THEN 'OA_BOT_BLOCKED' ELSE 'DOWNLOAD_FAILED' END
    WHEN b = 3 THEN 'DOWNLOAD_FAILED' ELSE 'PAYWALLED' END AS status FROM (SELECT event_id, user_id, {EVENT} FROM events))"""


def downloads(spark, sf_dir):
    link = F.when(F.col("a") < 4, "https://x/y.pdf")
    return events(spark, sf_dir).select("event_id", "user_id", rules.acquisition_state(link, pick(F.col("b"), *ACCESS), F.col("c") < 6).alias("status"))


@query(f"WITH {LEDGER} SELECT event_id, status FROM l")
def acquisition_states(spark, sf_dir):
    return downloads(spark, sf_dir).select("event_id", "status")


@query(f"""WITH {LEDGER}, c AS (SELECT count(*) AS selected, count(*) FILTER (status IN ('OA_DOWNLOADED', 'PREPRINT_AVAILABLE')) AS obtained, count(*) FILTER (status NOT IN ('OA_DOWNLOADED', 'PREPRINT_AVAILABLE')) AS gaps FROM l)
    SELECT selected, obtained, gaps, (SELECT count(*) FROM customer) AS candidates, round(obtained / selected, 4)::DOUBLE AS rate, true AS survived, 'SUCCESS_WITH_RETRIEVAL_AND_ACQUISITION_GAPS' AS status FROM c""")
def acquisition_reconciliation(spark, sf_dir):
    return handoff.acquisition(downloads(spark, sf_dir), candidates=table(spark, sf_dir, "customer").select("c_custkey"), frozen=1, retrieval_gaps=True)


@query("""WITH w AS (SELECT s_suppkey, list_filter(regexp_split_to_array(regexp_replace(s_comment_, '[^a-zA-Z0-9_一-龥\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 1) AS ws, s_name, s_nationkey FROM (SELECT *, s_name || ' of the ' || s_nationkey || 'th, nation: a report' AS s_comment_ FROM supplier))
    SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'UnknownYear' ELSE (1990 + s_nationkey)::VARCHAR END || '_' || CASE s_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'PhD_' ELSE 'Thesis_' END
        || regexp_replace(regexp_split_to_array(trim(s_name), '[, ]+')[1], '[^a-zA-Z0-9_一-龥]', '', 'g') || '_' || left(array_to_string(ws[1:6], '_'), 50) || '.pdf' AS file_name FROM w""")
def file_names(spark, sf_dir):
    n = F.col("s_nationkey")
    title = F.concat("s_name", F.lit(" of the "), n, F.lit("th, nation: a report"))
    year, kind, degree = F.when(n % 4 != 0, 1990 + n), F.when(n % 3 != 0, "Thesis"), F.when(n % 3 == 1, "Doctor of Science").when(n % 3 == 2, "other")
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.file_name(title, F.col("s_name"), year, kind, degree).alias("file_name"))


@query("""SELECT p_partkey, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS abstract FROM (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'Not available' ELSE repeat(p_name || ' ', p_size - 1) || p_name END AS t FROM part)""")
def rebuilt_abstracts(spark, sf_dir):
    """Texts of up to 50 times a part's name go into an inverted index and come back."""
    words = F.split(F.concat(F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size") - 1), "p_name"), " ")
    p = table(spark, sf_dir, "part").withColumn("w", words)
    index = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("w")), lambda x: F.struct(x.alias("key"), F.filter(F.transform("w", lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull()).alias("value"))))
    return p.select("p_partkey", rules.abstract_of(F.when(F.col("p_size") % 9 != 0, index)).alias("abstract"))


@query(f"""SELECT event_id, strftime(CASE a WHEN 0 THEN ts WHEN 1 THEN ts WHEN 4 THEN ts::DATE::TIMESTAMP WHEN 5 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS moment FROM (SELECT event_id, ts::TIMESTAMP AS ts, {EVENT} FROM events)""")
def moments(spark, sf_dir):
    a, ts = F.col("a"), F.col("ts").cast("timestamp")
    text = (
        F.when(a == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(a == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(a == 2, "soon")
        .when(a == 3, "")
        .when(a == 4, F.date_format(ts, "yyyy-MM-dd"))
        .when(a == 5, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    )
    return events(spark, sf_dir).select("event_id", F.date_format(rules.moment(text), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("SELECT conv_id, turn, contains(coalesce(text, ''), chr(65533)) AS lost, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n|\\f'), lambda p: regexp_replace(p, '\\s+', '', 'g') <> '')) AS paragraphs FROM conversations")
def text_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rules.has_replacement(F.col("text")).alias("lost"), F.size(rules.paragraphs(F.coalesce("text", F.lit("")))).cast("long").alias("paragraphs"))


@query("""SELECT page_id, 'page: ' || page_id || ' of 9.' AS sentence, 'fp-' || left(sha256('page: ' || page_id || ' of 9.' || chr(31) || 'b'), 16) AS fingerprint, 'REC' || CASE WHEN length(page_id::VARCHAR) < 3 THEN lpad(page_id::VARCHAR, 3, '0') ELSE page_id::VARCHAR END AS number,
    coalesce(CASE WHEN page_id % 2 = 0 THEN 'r' || page_id END, 'x' || page_id) AS identity FROM pages""")
def record_marks(spark, sf_dir):
    i = F.col("page_id")
    text = F.concat(F.lit("First one. page: "), i, F.lit(" of 9. Last!"))
    found = rules.sentence_with(text, F.concat(F.lit("PAGE: "), i, F.lit(" ")))
    mark = rules.fingerprint("fp-", F.concat(F.lit("  PAGE:\n"), i, F.lit("  of 9. ")), F.lit("B"))
    who = rules.first_given(F.lit(" "), F.when(i % 2 == 0, F.concat(F.lit("r"), i)), F.concat(F.lit("x"), i))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("sentence"), mark.alias("fingerprint"), rules.numbered("REC", i).alias("number"), who.alias("identity"))


@query("""SELECT p_partkey, list_contains(string_split(p_name, ' '), string_split(p_name, ' ')[2]) AS present, list_contains(string_split(lower(p_name), ' '), left(lower(string_split(p_name, ' ')[1]), 3)) AS part_of_word FROM part""")
def vocabulary_in_source(spark, sf_dir):
    words = F.split("p_name", " ")
    present = rules.occurs(F.concat(F.lit(" "), F.upper(words[1]), F.lit(" ")), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", present.alias("present"), rules.occurs(F.left(words[0], F.lit(3)), F.col("p_name")).alias("part_of_word"))


@query("""WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[A-Za-z]{2,}[0-9]') THEN 'word-number' END, CASE WHEN regexp_matches(text, '[A-Za-z]{2,}-\\s+[A-Za-z]{2,}') THEN 'broken-word' END,
        CASE WHEN regexp_matches(text, '^[a-z]') AND trim(coalesce(before, '')) <> '' AND NOT regexp_matches(before, '[.!?。！？:;][\\s)\\]”’"'']*$') THEN 'paragraph-boundary' END], lambda x: x IS NOT NULL), ',') AS risks FROM t""")
def source_risks(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.array_join(rules.source_risk(F.col("text"), F.col("before")), ",").alias("risks"))


REVIEWS = "r AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS reason, CASE WHEN o_custkey % 5 = 0 THEN 'T' || o_custkey ELSE '' END AS task_id FROM orders)"


@query(f"""WITH {REVIEWS}, b AS (SELECT id, CASE WHEN id % 64 = 0 THEN 'X' ELSE status END AS status, reason, CASE WHEN task_id <> '' THEN 'B' || task_id ELSE ' ' END AS task_id FROM r WHERE id % 3 <> 0),
    j AS (SELECT r.id AS x, b.id AS y, (r.status, r.reason, r.task_id) IS NOT DISTINCT FROM (b.status, b.reason, b.task_id) AS same FROM r FULL JOIN b USING (id))
    SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, count(*) FILTER (x IS NULL OR y IS NULL OR NOT same) AS differing, 0::BIGINT AS shared_tasks, 'INDEPENDENT' AS verdict FROM j""")
def source_independence(spark, sf_dir):
    task = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("T"), "o_custkey")).otherwise("")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason"), task.alias("task_id"))
    b = a.where("id % 3 <> 0").select("id", F.when(F.col("id") % 64 == 0, "X").otherwise(F.col("status")).alias("status"), "reason", F.when(F.col("task_id") != "", F.concat(F.lit("B"), "task_id")).otherwise(" ").alias("task_id"))
    return handoff.independence(a, b, ["status", "reason"])


@query("""WITH s AS (SELECT l_orderkey, row(l_linenumber, l_partkey, l_suppkey) AS place, l_partkey % 3 + l_linenumber AS page, l_linenumber * 900 + l_partkey % 700 AS b, l_linenumber * 900 + 400 AS e, CASE WHEN l_suppkey % 4 = 0 THEN 'Introduction' WHEN l_suppkey % 4 = 1 THEN 'Results' END AS sec FROM lineitem),
    w AS (SELECT *, lag(page) OVER o AS p0, lag(e) OVER o AS e0, lag(sec) OVER o AS s0 FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY place)),
    f AS (SELECT l_orderkey, place, CASE WHEN abs(page - p0) > 1 THEN 'PAGES_APART' WHEN abs(b - e0) > 1000 THEN 'TOO_FAR' WHEN s0 = 'Introduction' AND sec = 'Results' THEN 'SECTIONS' END AS fault FROM w)
    SELECT l_orderkey, count(*) AS spans, arg_min(fault, place) FILTER (fault IS NOT NULL) AS fault FROM f GROUP BY 1""")
def span_coherence(spark, sf_dir):
    n, s = F.col("l_linenumber"), F.col("l_suppkey") % 4
    spans = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"),
        (F.col("l_partkey") % 3 + n).alias("page"),
        (n * 900 + F.col("l_partkey") % 700).alias("start"),
        (n * 900 + 400).alias("end"),
        F.when(s == 0, "Introduction").when(s == 1, "Results").alias("section"),
    )
    return handoff.coherence(spans, ["l_orderkey"], "place", 1000)


@query("""WITH v AS (SELECT 'E' || l_partkey AS id FROM lineitem WHERE l_linenumber = 1 UNION SELECT 'E' || l_suppkey FROM lineitem WHERE l_linenumber = 2), r AS (SELECT 'E' || p_partkey AS id FROM part)
    SELECT count(*) AS records, count(*) FILTER (NOT EXISTS (SELECT 1 FROM v WHERE v.id = r.id)) AS orphans, round(1 - count(*) FILTER (NOT EXISTS (SELECT 1 FROM v WHERE v.id = r.id)) / count(*), 4)::DOUBLE AS covered FROM r""")
def evidence_chain(spark, sf_dir):
    records = table(spark, sf_dir, "part").select(F.concat(F.lit("E"), "p_partkey").alias("id"))
    n = F.col("l_linenumber")
    verdicts = table(spark, sf_dir, "lineitem").select(F.when(n == 1, F.concat(F.lit("E"), "l_partkey")).alias("evidence_id"), F.when(n == 2, F.array(F.concat(F.lit("E"), "l_suppkey"))).alias("reviewed"))
    return handoff.evidence_chain(records, verdicts, ["evidence_id"], ["reviewed"])


@query("""WITH c AS (SELECT o_orderkey AS claim_id, l_partkey AS e FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber < 4) ON l_orderkey = o_orderkey),
    m AS (SELECT claim_id, e, p_partkey IS NOT NULL AS k, p_size AS z FROM c LEFT JOIN part ON p_partkey = e AND p_partkey % 50 <> 0),
    f AS (SELECT claim_id, [CASE WHEN bool_or(e IS NULL) THEN 'NO_EVIDENCE_IDS' END, CASE WHEN bool_or(e IS NOT NULL AND NOT k) THEN 'EVIDENCE_NOT_FOUND' END, CASE WHEN bool_or(k AND z % 10 = 0) THEN 'CONTEXT_INSUFFICIENT' END, CASE WHEN bool_or(k AND z % 10 = 1) THEN 'CONTEXT_PARTIAL' END,
        CASE WHEN bool_or(k AND z % 7 > 2) THEN 'STATUS_WITHOUT_EVIDENCE' END, CASE WHEN bool_or(k AND z % 6 = 0) THEN 'SUPPORT_NOT_REPORTED' END, CASE WHEN bool_or(k AND z % 8 < 2) THEN 'STRENGTH_UNKNOWN' END] AS x FROM m GROUP BY 1)
    SELECT claim_id, array_to_string(list_filter(x, lambda v: v IS NOT NULL), ',') AS issues FROM f""")
def consensus_eligibility(spark, sf_dir):
    z = F.col("p_size")
    # an order has few lines, so its list is short
    named = table(spark, sf_dir, "lineitem").where("l_linenumber < 4").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("evidence_ids"))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id")).join(named, F.col("claim_id") == F.col("l_orderkey"), "left").select("claim_id", "evidence_ids")
    evidence = table(spark, sf_dir, "part").where("p_partkey % 50 <> 0").select(
        F.col("p_partkey").alias("evidence_id"),
        F.when(z % 10 == 0, "INSUFFICIENT").when(z % 10 == 1, "PARTIALLY_SUFFICIENT").otherwise("SUFFICIENT").alias("context"),
        pick(z % 7, "SUPPORTED", "PARTIALLY_SUPPORTED", "CONTRADICTORY", "AMBIGUOUS", "UNSUPPORTED", None, "X").alias("status"),
        F.when(z % 6 == 0, "NR").otherwise("EXPLICIT").alias("support"),
        F.when(z % 8 == 0, "UNKNOWN").when(z % 8 > 1, "E1_DIRECT").alias("strength"),
    )
    return handoff.eligibility(claims, evidence)


COUNTERS = ["exact_match", "fuzzy_match", "not_found", "unverified", "value_unit_mismatch"]


@query(f"""WITH o AS (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN 'not_found' WHEN event_id % 89 = 0 THEN 'value_unit_mismatch' WHEN event_id % 83 = 0 THEN 'unverified' WHEN event_id % 3 = 0 THEN 'fuzzy_match' ELSE 'exact_match' END AS m FROM events),
    n AS (SELECT user_id, {', '.join(f"count(*) FILTER (m = '{c}') AS {c}" for c in COUNTERS)} FROM o GROUP BY 1) SELECT *, not_found + unverified + value_unit_mismatch > 0 AS failed FROM n""")
def quote_gate(spark, sf_dir):
    i = F.col("event_id")
    outcome = F.when(i % 97 == 0, "not_found").when(i % 89 == 0, "value_unit_mismatch").when(i % 83 == 0, "unverified").when(i % 3 == 0, "fuzzy_match").otherwise("exact_match")
    return handoff.outcome_counts(events(spark, sf_dir).withColumn("outcome", outcome), ["user_id"], "outcome", COUNTERS)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY i, event_type) AS place FROM f""")
def first_seen_items(spark, sf_dir):
    return handoff.first_seen(events(spark, sf_dir), ["user_id"], "event_type", "event_id").withColumn("place", F.col("place").cast("long"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'reserve' WHEN event_type = 'purchase' THEN 'settle' ELSE 'release' END AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS amount FROM events),
    s AS (SELECT *, sum(CASE WHEN kind = 'reserve' THEN amount ELSE -amount END) OVER w AS open, sum(CASE WHEN kind = 'settle' THEN amount // 2 ELSE 0 END) OVER w AS used FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, open::BIGINT AS open, used::BIGINT AS used, max((kind = 'reserve' AND open + used > 150)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS exhausted FROM s""")
def reserve_ledger(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "reserve").when(F.col("event_type") == "purchase", "settle").otherwise("release")
    e = events(spark, sf_dir).select("user_id", "event_id", kind.alias("kind"), F.col("k").cast("long").alias("amount"), F.floor(F.col("k") / 2).cast("long").alias("settled"))
    return handoff.ledger(e, ["user_id"], "event_id", 150).select("event_id", "open", "used", "exhausted")


@query("""SELECT lang, count(*) AS cases, count(*) FILTER (source IS NOT DISTINCT FROM CASE WHEN doc_id % 20 = 0 THEN NULL ELSE source END) AS right, round(count(*) FILTER (source IS NOT DISTINCT FROM CASE WHEN doc_id % 20 = 0 THEN NULL ELSE source END) / count(*), 4)::DOUBLE AS share,
    CASE WHEN round(count(*) FILTER (source IS NOT DISTINCT FROM CASE WHEN doc_id % 20 = 0 THEN NULL ELSE source END) / count(*), 4) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS status FROM documents GROUP BY 1""")
def benchmark_accuracy(spark, sf_dir):
    found = F.when(F.col("doc_id") % 20 != 0, F.col("source"))
    return handoff.accuracy(table(spark, sf_dir, "documents"), ["lang"], F.col("source"), found, 0.95)
