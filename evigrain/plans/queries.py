"""Named queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, identity, textual
from ..operators import agreement, consensus, corpus, coverage, ordered, search
from ..session import table
from .registry import query

def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: a user is a topic, a day a group, the type a stance, the value a strength."""
    e = table(spark, sf_dir, "events")
    raw = F.create_map(*(F.lit(x) for p in (("purchase", "support"), ("click", "Support"), ("error", "OPPOSE"), ("view", "conditional"), ("signup", "mixed")) for x in p))[F.col("event_type")]
    tier = F.when(F.col("value") >= 100, "E1").when(F.col("value") >= 50, "E2").when(F.col("value") >= 20, "AUTHOR_INTERPRETATION").when(F.col("value") >= 2, "E3_REFERENCED").otherwise("E4_NR")
    level = F.when(F.col("event_id") % 7 == 0, "SERIOUS").when(F.col("event_id") % 5 == 0, "MEDIUM").otherwise("LOW")
    return e.select(
        F.col("event_id").alias("claim_id"),
        F.col("user_id").alias("topic"),
        F.date_format("ts", "yyyy-MM-dd").alias("group_id"),
        F.hour("ts").alias("hour"),
        evidence.stance(raw).alias("stance"),
        evidence.strength(tier).alias("strength"),
        evidence.weight(tier, risk_of_bias=level).alias("weight"),
        (F.col("event_id") % 3 != 0).alias("verified"),
        F.col("value").alias("metric"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


CLAIMS = """
    claims AS (SELECT event_id AS claim_id, user_id AS topic, strftime(ts, '%Y-%m-%d') AS group_id, hour(ts) AS hour,
        CASE event_type WHEN 'purchase' THEN 'SUPPORT' WHEN 'click' THEN 'SUPPORT' WHEN 'error' THEN 'REFUTE'
             WHEN 'view' THEN 'CONDITIONAL' ELSE 'NEUTRAL' END AS stance,
        CASE WHEN value >= 100 THEN 'DIRECT_EMPIRICAL' WHEN value >= 50 THEN 'MODELED_EMPIRICAL' WHEN value >= 20 THEN 'AUTHOR_INTERPRETATION'
             WHEN value >= 2 THEN 'SECONDARY_EVIDENCE' ELSE 'NOT_REPORTED' END AS strength,
        round(CASE WHEN value >= 100 THEN 1.0 WHEN value >= 50 THEN 0.8 WHEN value >= 20 THEN 0.4 WHEN value >= 2 THEN 0.2 ELSE 0.0 END::DOUBLE
            * CASE WHEN event_id % 7 = 0 THEN 0.6 WHEN event_id % 5 = 0 THEN 0.85 ELSE 1.0 END::DOUBLE, 3) AS weight,
        event_id % 3 <> 0 AS verified, value AS metric, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def _consensus_sql(keys: str, source: str = "claims") -> str:
    return f"""
    g AS (SELECT {keys}, group_id,
        sum(CASE WHEN stance='SUPPORT' THEN weight ELSE 0 END) s, sum(CASE WHEN stance='REFUTE' THEN weight ELSE 0 END) r,
        sum(CASE WHEN stance='CONDITIONAL' THEN weight ELSE 0 END) c, count(*) n,
        max(CASE WHEN stance='SUPPORT' AND verified THEN 1 ELSE 0 END) v,
        max(CASE WHEN stance='SUPPORT' AND strength IN ('DIRECT_EMPIRICAL','MODELED_EMPIRICAL') THEN 1 ELSE 0 END) e
      FROM {source} WHERE weight > 0 AND stance IN ('SUPPORT','REFUTE','CONDITIONAL') GROUP BY {keys}, group_id),
    z AS (SELECT *, CASE WHEN s + r + c > 1.0 THEN 1.0 / (s + r + c) ELSE 1.0 END f FROM g),
    t AS (SELECT {keys}, sum(s * f) s, sum(r * f) r, sum(c * f) c, sum(n) AS claims, count(*) AS groups, sum(v) v, max(e) e FROM z GROUP BY {keys}),
    q AS (SELECT *, s + r + c AS w, s / (s + r + c) sr, r / (s + r + c) rr, c / (s + r + c) cr FROM t)
    SELECT {keys}, claims, groups, round(w, 4) AS total_weight, round(sr, 4) AS support_ratio, round(rr, 4) AS refute_ratio, round(cr, 4) AS conditional_ratio,
      CASE WHEN w < 1.0 OR claims < 2 OR groups < 2 THEN 'INSUFFICIENT_EVIDENCE'
           WHEN (sr >= 0.4 AND rr >= 0.4) OR (sr BETWEEN 0.3 AND 0.7 AND rr BETWEEN 0.3 AND 0.7) THEN 'ACTIVE_CONTROVERSY'
           WHEN cr >= 0.45 THEN 'CONDITIONAL_CONSENSUS'
           WHEN sr >= 0.8 AND v >= 2 AND e = 1 THEN 'STRONG_CONSENSUS'
           WHEN sr >= 0.65 THEN 'MODERATE_CONSENSUS' ELSE 'CONDITIONAL_CONSENSUS' END AS consensus
    FROM q"""


@query(f"WITH {CLAIMS}, {_consensus_sql('topic')}")
def topic_consensus(spark, sf_dir):
    return consensus.topic_consensus(claims(spark, sf_dir))


@query(f"""WITH {CLAIMS}, b AS (SELECT *, CASE WHEN hour < 20 THEN CAST(hour // 12 AS VARCHAR) END AS stratum, false AS overall FROM claims UNION ALL SELECT *, NULL AS stratum, true AS overall FROM claims),
    {_consensus_sql('topic, stratum, overall', 'b')}""")
def topic_stratum_consensus(spark, sf_dir):
    return consensus.stratified_consensus(claims(spark, sf_dir).withColumn("stratum", F.when(F.col("hour") < 20, F.floor(F.col("hour") / 12))))


@query(f"""WITH {CLAIMS} SELECT reason, count(*) AS claims FROM (
    SELECT 'NEUTRAL_STANCE' AS reason FROM claims WHERE stance = 'NEUTRAL' UNION ALL SELECT 'ZERO_WEIGHT' FROM claims WHERE weight <= 0) GROUP BY reason""")
def consensus_exclusions(spark, sf_dir):
    return consensus.exclusions(claims(spark, sf_dir))


@query(f"""WITH {CLAIMS}, ch AS (SELECT claim_id - 1 AS claim_id, k % 4 AS group_id, CASE WHEN k % 2 = 0 THEN 'REFUTES' ELSE 'WEAKENS' END AS challenge FROM claims WHERE stance = 'REFUTE'
        UNION ALL SELECT claim_id - 2, k % 4, 'WEAKENS' FROM claims WHERE stance = 'REFUTE'),
    g AS (SELECT claim_id, group_id, least(sum(CASE challenge WHEN 'REFUTES' THEN 0.5 ELSE 0.25 END), 0.5) a FROM ch GROUP BY 1, 2),
    t AS (SELECT claim_id, sum(a)::DOUBLE p FROM g GROUP BY 1)
    SELECT claim_id, weight, coalesce(p, 0)::DOUBLE AS penalty, round(greatest(0, weight - coalesce(p, 0)), 4)::DOUBLE AS adjusted FROM claims LEFT JOIN t USING (claim_id)""")
def challenge_penalty(spark, sf_dir):
    c = claims(spark, sf_dir)
    refuting = c.where("stance = 'REFUTE'")
    one = refuting.select((F.col("claim_id") - 1).alias("claim_id"), (F.col("k") % 4).alias("group_id"), F.when(F.col("k") % 2 == 0, "REFUTES").otherwise("WEAKENS").alias("challenge"))
    two = refuting.select((F.col("claim_id") - 2).alias("claim_id"), (F.col("k") % 4).alias("group_id"), F.lit("WEAKENS").alias("challenge"))
    return consensus.challenged_weights(c.select("claim_id", "weight"), one.unionByName(two))


@query(f"""WITH {CLAIMS}, t AS (SELECT topic, max((stance='SUPPORT')::INT) hs, max((stance='REFUTE')::INT) hr,
        list(DISTINCT k % 10) FILTER (stance='SUPPORT') s, list(DISTINCT k % 10) FILTER (stance='REFUTE') r,
        avg(metric) FILTER (stance='SUPPORT') a, avg(metric) FILTER (stance='REFUTE') b FROM claims GROUP BY topic)
    SELECT topic, hs AS has_support, hr AS has_refute, CASE WHEN hs = 0 OR hr = 0 THEN 'NO_CONTROVERSY' WHEN NOT list_has_any(s, r) THEN 'METHOD'
        WHEN greatest(a, b) / nullif(least(a, b), 0) > 2 THEN 'MAGNITUDE' ELSE 'UNRESOLVED' END AS controversy FROM t""")
def controversy_diagnosis(spark, sf_dir):
    return consensus.diagnosis(claims(spark, sf_dir).withColumn("method", F.col("k") % 10))


def reviewers(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    words = lambda c: F.when(c == 1, "include").otherwise("Excluded")
    a = l.select(F.col("doc_id").alias("id"), evidence.screening_status(words(F.col("quality"))).alias("status"))
    b = l.select(F.col("doc_id").alias("id"), evidence.screening_status(F.when(F.col("doc_id") % 11 == 0, "maybe").otherwise(words(1 - F.col("toxic")))).alias("status"))
    return a, b


REVIEWERS = """r AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'Include' ELSE 'Exclude' END sa,
    CASE WHEN doc_id % 11 = 0 THEN 'Uncertain' WHEN toxic = 0 THEN 'Include' ELSE 'Exclude' END sb FROM labels)"""


@query(f"""WITH {REVIEWERS}, m AS (SELECT count(*) n, avg((sa = sb)::INT) po, avg((sa='Include')::INT) a0, avg((sa='Exclude')::INT) a1, avg((sa='Uncertain')::INT) a2,
        avg((sb='Include')::INT) b0, avg((sb='Exclude')::INT) b1, avg((sb='Uncertain')::INT) b2, avg(((sa='Include') = (sb='Include'))::INT) bpo FROM r),
    p AS (SELECT *, a0*b0 + a1*b1 + a2*b2 pe, a0*b0 + (1-a0)*(1-b0) bpe FROM m),
    k AS (SELECT *, (po - pe) / (1 - pe) kappa, (bpo - bpe) / (1 - bpe) bk, sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))) se FROM p)
    SELECT n AS sample_size, CASE WHEN n >= 5 THEN 'PASS' ELSE 'UNDERPOWERED' END AS sample_status, round(po, 4) AS observed_agreement, round(pe, 4) AS expected_agreement,
      round(kappa, 4) AS cohens_kappa, round(greatest(-1, kappa - 1.96 * se), 4) AS ci_lower, round(least(1, kappa + 1.96 * se), 4) AS ci_upper, round(bk, 4) AS binary_kappa,
      CASE WHEN kappa >= 0.81 THEN 'Almost Perfect' WHEN kappa >= 0.61 THEN 'Substantial' WHEN kappa >= 0.41 THEN 'Moderate' WHEN kappa >= 0.21 THEN 'Fair' ELSE 'Slight / Poor' END AS interpretation
    FROM k""")
def screening_kappa(spark, sf_dir):
    return agreement.cohens_kappa(*reviewers(spark, sf_dir))


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS only_a, count(*) FILTER (d.doc_id IS NULL) AS only_b, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS common, count(*) AS all_ids
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def reviewer_coverage(spark, sf_dir):
    return agreement.reviewer_coverage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query(f"""WITH {REVIEWERS} SELECT id, sa AS status_a, sb AS status_b, CASE WHEN sa = sb THEN 'AGREED' ELSE 'ARBITRATION' END AS outcome FROM r""")
def screening_decisions(spark, sf_dir):
    return agreement.decision_table(*reviewers(spark, sf_dir))


EXECUTION = {"P": "SEARCHED_PARTIAL", "F": "SEARCHED_COMPLETE", "O": "SEARCHED_VIA_USER_EXPORT"}
PAGINATION = {"1-URGENT": "COMPLETE", "2-HIGH": "TRUNCATED_BY_LIMIT", "3-MEDIUM": "UNKNOWN", "4-NOT SPECIFIED": "FAILED_MIDWAY", "5-LOW": "COMPLETE"}


def executions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ordinal"),
        (F.col("o_custkey") % 25).alias("source_id"),
        (F.col("o_orderkey") % 40).alias("query_id"),
        F.when(F.col("o_orderkey") % 13 == 0, "ACCESS_DENIED").otherwise(evidence.lookup(EXECUTION, F.col("o_orderstatus"))).alias("execution_status"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 7).alias("reported_hits"),
        (F.col("o_orderkey") % 5).alias("retrieved"),
        evidence.lookup(PAGINATION, F.col("o_orderpriority")).alias("pagination"),
    )


X = """x AS (SELECT o_orderkey AS ordinal, o_custkey % 25 AS source_id, o_orderkey % 40 AS query_id,
    CASE WHEN o_orderkey % 13 = 0 THEN 'ACCESS_DENIED' WHEN o_orderstatus = 'P' THEN 'SEARCHED_PARTIAL' WHEN o_orderstatus = 'F' THEN 'SEARCHED_COMPLETE' WHEN o_orderstatus = 'O' THEN 'SEARCHED_VIA_USER_EXPORT' END AS execution_status,
    CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 7 END AS reported_hits, o_orderkey % 5 AS retrieved,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'COMPLETE' WHEN '2-HIGH' THEN 'TRUNCATED_BY_LIMIT' WHEN '3-MEDIUM' THEN 'UNKNOWN' WHEN '4-NOT SPECIFIED' THEN 'FAILED_MIDWAY' WHEN '5-LOW' THEN 'COMPLETE' END AS pagination FROM orders)"""
STATUS = """CASE WHEN execution_status = 'SEARCHED_PARTIAL' THEN 'PARTIAL' WHEN execution_status IS NULL OR execution_status NOT IN ('SEARCHED_COMPLETE','SEARCHED_VIA_USER_EXPORT') THEN 'UNKNOWN'
    WHEN reported_hits = 0 AND retrieved = 0 THEN 'COMPLETE' WHEN pagination IN ('TRUNCATED_BY_LIMIT','PARTIAL','FAILED_MIDWAY') THEN 'PARTIAL'
    WHEN reported_hits > 0 THEN CASE WHEN retrieved < reported_hits THEN 'PARTIAL' ELSE 'COMPLETE' END WHEN pagination = 'COMPLETE' THEN 'COMPLETE' WHEN retrieved = 0 THEN 'UNKNOWN' ELSE 'PARTIAL' END"""
PLAN = "p AS (SELECT n_nationkey AS source_id, q AS query_id FROM nation, range(0, 48) t(q))"
LEDGER = f"""{X}, {PLAN}, l AS (SELECT source_id, query_id, arg_max(struct_pack(execution_status, reported_hits, retrieved, pagination), ordinal) AS z FROM x GROUP BY 1, 2),
    j AS (SELECT p.source_id, p.query_id, coalesce(z.execution_status, 'NOT_SEARCHED') AS execution_status, z.reported_hits AS reported_hits, coalesce(z.retrieved, 0) AS retrieved, z.pagination AS pagination FROM p LEFT JOIN l USING (source_id, query_id)),
    led AS (SELECT *, {STATUS} AS coverage FROM j)"""


def plan(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long"))).alias("query_id"))


@query(f"WITH {X} SELECT ordinal, {STATUS} AS coverage FROM x")
def coverage_truth_table(spark, sf_dir):
    x = executions(spark, sf_dir)
    return x.select("ordinal", evidence.coverage_status(F.col("execution_status"), F.col("reported_hits"), F.col("retrieved"), F.col("pagination")).alias("coverage"))


@query(f"WITH {LEDGER} SELECT * FROM led")
def ledger_reconcile(spark, sf_dir):
    return coverage.reconcile(plan(spark, sf_dir), executions(spark, sf_dir))


@query(f"WITH {X}, {PLAN} SELECT source_id, query_id FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source_id = p.source_id AND x.query_id = p.query_id)")
def retrieval_gaps(spark, sf_dir):
    return coverage.gaps(plan(spark, sf_dir), executions(spark, sf_dir))


@query(f"""WITH {LEDGER} SELECT source_id, count(*) AS queries, sum(reported_hits) AS reported_hits, sum(retrieved) AS retrieved,
    round(count(*) FILTER (execution_status <> 'NOT_SEARCHED') / count(*), 4) AS execution_rate,
    CASE WHEN bool_and(coverage = 'COMPLETE') THEN 'COMPLETE' WHEN bool_or(coverage = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'PARTIAL' END AS coverage FROM led GROUP BY source_id""")
def source_rollup(spark, sf_dir):
    return coverage.by_source(coverage.reconcile(plan(spark, sf_dir), executions(spark, sf_dir)))


NOTED = """e AS (SELECT n_name AS source_id, o.* EXCLUDE (o_custkey), 'export of ' || n_name || CASE WHEN o_custkey % 1000 = 999 THEN ' by Scopus' ELSE '' END AS notes
    FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'RATE_LIMITED' WHEN o_orderstatus = 'F' THEN 'SEARCHED_COMPLETE' ELSE 'SEARCHED_WITH_ERRORS' END AS execution_status,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 90 END AS reported_hits, o_orderkey % 90 - o_orderkey % 7 AS retrieved, o_orderpriority AS pagination FROM orders) o JOIN nation ON n_nationkey = o_custkey % 24)"""


@query(f"""WITH {NOTED}, c AS (SELECT count(*) FILTER (execution_status = 'RATE_LIMITED' AND reported_hits = 0) AS z, count(*) FILTER (execution_status = 'SEARCHED_COMPLETE' AND contains(notes, 'Scopus')) AS s,
        count(*) FILTER (coalesce(pagination, '') = '') AS g, count(*) FILTER (reported_hits IS NOT NULL AND retrieved > reported_hits) AS h, count(reported_hits) AS w,
        (SELECT count(*) FROM nation WHERE n_name NOT IN (SELECT source_id FROM e)) AS m FROM e),
    k AS (SELECT CASE WHEN z > 0 THEN 'FAIL' ELSE 'PASS' END AS no_access_failure_as_zero, CASE WHEN s > 0 THEN 'FAIL' ELSE 'PASS' END AS no_cross_source_substitution, CASE WHEN g > 0 THEN 'FAIL' ELSE 'PASS' END AS pagination_recorded,
        CASE WHEN w = 0 THEN 'UNKNOWN' WHEN h > 0 THEN 'FAIL' ELSE 'PASS' END AS hit_reconciliation_valid, CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS planned_sources_accounted, 'PASS' AS corpus_frozen FROM c)
    SELECT *, CASE WHEN 'FAIL' IN (no_access_failure_as_zero, no_cross_source_substitution, pagination_recorded, hit_reconciliation_valid, planned_sources_accounted) THEN 'REJECT' WHEN hit_reconciliation_valid = 'UNKNOWN' THEN 'PASS_WITH_UNKNOWNS' ELSE 'PASS' END AS verdict FROM k""")
def coverage_gate(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("source_id"))
    status = F.when(F.col("o_orderstatus") == "P", "RATE_LIMITED").when(F.col("o_orderstatus") == "F", "SEARCHED_COMPLETE").otherwise("SEARCHED_WITH_ERRORS")
    key = F.col("o_orderkey")
    ledger = o.join(n, F.col("o_custkey") % 24 == F.col("n_nationkey")).select(
        "source_id",
        status.alias("execution_status"),
        F.when(F.col("o_orderstatus") != "P", key % 90).alias("reported_hits"),
        (key % 90 - key % 7).alias("retrieved"),
        F.col("o_orderpriority").alias("pagination"),
        F.concat(F.lit("export of "), "source_id", F.when(F.col("o_custkey") % 1000 == 999, " by Scopus").otherwise("")).alias("notes"),
    )
    return coverage.gate(ledger, frozen=True, planned=n.select("source_id"))


KEYED = "regexp_replace(lower(text), '[^a-z0-9一-龥]', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, source, nullif({KEYED}, '') AS k FROM documents)
    SELECT doc_id, source, copies FROM (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY k) END AS copies, CASE WHEN k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k ORDER BY doc_id) END AS n FROM d) WHERE n = 1""")
def frozen_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(identity.title_key(F.col("text")).cast("binary")).alias("key"))
    return corpus.frozen(d, [F.col("key")], "doc_id").drop("key")


@query(f"""WITH d AS (SELECT DISTINCT source, nullif({KEYED}, '') AS k FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM d WHERE k IS NOT NULL)
    SELECT source, count(*) AS keys, count(*) FILTER (c = 1) AS unique_keys FROM n GROUP BY source""")
def source_contribution(spark, sf_dir):
    return corpus.contributions(table(spark, sf_dir, "documents"), F.md5(identity.title_key(F.col("text")).cast("binary")), "source")


@query(f"""SELECT md5({KEYED}) AS record_key, count(*) AS rows, count(DISTINCT source) AS n_values, min(source) AS least, max(source) AS greatest FROM documents WHERE {KEYED} <> '' GROUP BY {KEYED} HAVING count(DISTINCT source) > 1""")
def metadata_conflicts(spark, sf_dir):
    return corpus.conflicts(table(spark, sf_dir, "documents"), F.md5(F.nullif(identity.title_key(F.col("text")), F.lit("")).cast("binary")), "source")


@query("""SELECT p_partkey, 'REC-' || left(sha256('title:' || regexp_replace(lower(trim(p_name)), '[^\\w\\s]', '', 'g') || '|year:' || p_size || '|author:' || lower(trim(p_brand))), 12) AS record_id FROM part""")
def record_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", identity.record_id(F.lit("NR"), F.col("p_name"), F.col("p_size"), F.col("p_brand")).alias("record_id"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS url_key FROM pages""")
def url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.url_key(F.col("url")).alias("url_key"))


@query("""SELECT c_custkey, 'x' || c_custkey || '.y+z' AS key_tail, '10.1000/x' || c_custkey || '.y+z' AS doi_key FROM customer""")
def doi_keys(spark, sf_dir):
    raw = F.concat(F.lit(" HTTPS://doi.org/10.1000/X"), F.col("c_custkey"), F.lit(".Y+z;. "))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("x"), "c_custkey", F.lit(".y+z")).alias("key_tail"), identity.doi_key(raw).alias("doi_key"))


WORDS = ["the", "and", "de la", "ing"]


@query("""WITH w(word) AS (VALUES ('the'), ('and'), ('de la'), ('ing')), c AS (SELECT doc_id, word, (length(lower(text)) - length(replace(lower(text), word, ''))) // length(word) AS n, lower(text) AS t FROM documents, w),
    h AS (SELECT doc_id, word, unnest(range(1, least(n, 10) + 1)) AS nth, t FROM c WHERE n > 0)
    SELECT doc_id, word, nth::INT AS nth, (list_sum(list_transform(list_slice(string_split(t, word), 1, nth), lambda x: length(x))) + (nth - 1) * length(word) + 1)::INT AS place FROM h""")
def keyword_search(spark, sf_dir):
    return search.keyword_hits(table(spark, sf_dir, "documents"), WORDS).select("doc_id", "word", "nth", "place")


@query("""WITH s AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' ' AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark)
    SELECT DISTINCT item_id, doc_id FROM q JOIN s ON contains(t, ' ' || q || ' ') WHERE len(string_split(q, ' ')) >= 6""")
def benchmark_quotes(spark, sf_dir):
    return search.quotes_in(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (SELECT doc_id, t, [(length(t) - length(replace(t, w, ''))) // length(w) for w in ['tion', 'ing', 'ment']] AS n FROM d)
    SELECT doc_id, greatest(0, least(10, round_even(len(list_filter(n, lambda x: x > 0)) / 3 * 6.0 + least(2.5, list_sum(n) / 10.0) + (contains(left(t, 200), 'tion')::INT + contains(left(t, 200), 'ing')::INT + contains(left(t, 200), 'ment')::INT) / 3 * 1.5, 0)))::INT AS score FROM h""")
def relevance_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textual.relevance(F.col("text"), F.left("text", F.lit(200)), ["tion", "ing", "ment"]).alias("score"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'ignore\\s+(all\\s+)?previous\\s+instructions|reveal\\s+(your\\s+)?system\\s+prompt|upload\\s+(the\\s+)?project\\s+files|execute\\s+this\\s+(command|script)|forget\\s+(all\\s+)?evidence\\s+rules') AS injected FROM conversations""")
def injection_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", textual.is_injection(F.col("text")).alias("injected"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\s*(?:[?]L|uL|ul)\\b')) AS microliter, len(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\s*[?]\\s*\\d+(?:\\.\\d+)?\\b')) AS plus_minus FROM documents""")
def ocr_anomalies(spark, sf_dir):
    c = textual.ocr_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c["MICROLITER"].alias("microliter"), c["PLUS_MINUS"].alias("plus_minus"))


@query("""WITH n AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\\b(?:not|no|never|none|neither|nor|without|cannot)\\b|n''t\\b')) AS negations FROM conversations) SELECT *, negations % 2 = 1 AS negated FROM n""")
def negation_parity(spark, sf_dir):
    said = F.col("text").isNotNull()  # a null text has no count in the SQL
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(said, textual.negations(F.col("text"))).alias("negations"), F.when(said, textual.is_negated(F.col("text"))).alias("negated"))


@query("""SELECT conv_id, turn, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def adjacent_turns(spark, sf_dir):
    return ordered.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "context")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events""")
def heading_asof(spark, sf_dir):
    return ordered.last_before(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "event_id", "last_signup").select("event_id", "last_signup")


@query("""SELECT p_brand AS paradigm, count(*) AS studies, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year, count(DISTINCT l_returnflag) AS methods FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def paradigm_clusters(spark, sf_dir):
    return _paradigms(spark, sf_dir)


def _paradigms(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("paradigm")).agg(F.count("*").alias("studies"), F.min(F.year("l_shipdate")).alias("first_year"), F.max(F.year("l_shipdate")).alias("last_year"), F.count_distinct("l_returnflag").alias("methods"))


@query("""WITH c AS (SELECT p_type, p_brand, min(l_shipdate) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    l AS (SELECT p_type, p_brand AS earlier, s AS earlier_start, lead(p_brand) OVER w AS later, lead(s) OVER w AS later_start FROM c WINDOW w AS (PARTITION BY p_type ORDER BY s, p_brand)) SELECT * FROM l WHERE later_start > earlier_start""")
def paradigm_shifts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return ordered.shifts(rows.groupBy("p_type", "p_brand").agg(F.min("l_shipdate").alias("s")), ["p_type"], "s", "p_brand")


LAYER_OF = {"signup": 6, "purchase": 5, "click": 2, "view": 1, "error": 0}


@query("""WITH f AS (SELECT user_id, value, ts, CASE event_type WHEN 'signup' THEN 6 WHEN 'purchase' THEN 5 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS p,
        event_id % 3 <> 0 AS live, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    b AS (SELECT * FROM f QUALIFY p = max(p) OVER (PARTITION BY user_id)),
    r AS (SELECT *, ts = max(ts) OVER u AS newest, k = max(k) OVER u AS surest FROM b WINDOW u AS (PARTITION BY user_id)),
    g AS (SELECT user_id, max(p) AS priority, count(DISTINCT value) AS n_values, min(value) AS v, bool_and(live AND ts IS NOT NULL) AS live,
        count(DISTINCT value) FILTER (newest) AS nt, max(value) FILTER (newest) AS tv, count(*) FILTER (surest) AS nc, max(value) FILTER (surest) AS cv FROM r GROUP BY user_id),
    w AS (SELECT *, CASE WHEN n_values = 1 THEN v WHEN live THEN CASE WHEN nt = 1 THEN tv END WHEN nc = 1 THEN cv END AS value FROM g)
    SELECT user_id, value, priority, n_values, CASE WHEN n_values > 1 AND value IS NULL THEN 'UNRESOLVED_CONFLICT' ELSE 'RESOLVED' END AS status FROM w""")
def fact_resolution(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return ordered.resolve(e, "user_id", evidence.lookup(LAYER_OF, F.col("event_type")), "value", volatile=F.col("event_id") % 3 != 0, time="ts", confidence="k")


@query("""WITH i AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
    SELECT user_id, event_type, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def no_progress_streaks(spark, sf_dir):
    return ordered.streaks(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type", 3)


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1, 2")
def event_projection(spark, sf_dir):
    return ordered.project(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def event_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return ordered.first_of(e, ["user_id", "event_type"], "event_id")


@query("""SELECT event_id, least(k, greatest(0, 500 - coalesce(sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS granted
    FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def run_quota(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return ordered.quota(e, ["user_id"], ["event_id"], "k", 500).select("event_id", "granted")


@query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS spent FROM events GROUP BY 1""")
def usage_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 2).alias("spent"))


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def seed_topk(spark, sf_dir):
    return ordered.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) <= 5 THEN 'PROCESSED' ELSE 'UNPROCESSED' END AS state FROM customer""")
def ceiling_split(spark, sf_dir):
    return ordered.split_at(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")], 5).select("c_custkey", "state")


@query("SELECT n_nationkey AS source_id FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def planned_minus_executed(spark, sf_dir):
    planned = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"))
    return planned.subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("source_id")))


@query("SELECT n_nationkey AS source_id FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def planned_and_executed(spark, sf_dir):
    planned = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"))
    return planned.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("source_id")))


@query("""WITH r AS (SELECT p_brand, arg_max(struct_pack(k := p_partkey, t := p_type, s := p_size), struct_pack(a := p_size, b := -p_partkey)) AS ref FROM part GROUP BY 1)
    SELECT p.p_partkey, ref.k AS reference, CASE WHEN p_type = ref.t AND abs(p_size - ref.s) <= 5 THEN 'COMPARABLE' WHEN p_type = ref.t OR abs(p_size - ref.s) <= 5 THEN 'PARTIAL' ELSE 'INCOMPARABLE' END AS status
    FROM part p JOIN r USING (p_brand) WHERE p_partkey <> ref.k""")
def comparability_star(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    best = p.groupBy("p_brand").agg(F.max_by(F.struct("p_partkey", "p_type", "p_size"), F.struct("p_size", -F.col("p_partkey"))).alias("ref"))
    same, near = F.col("p_type") == F.col("ref.p_type"), F.abs(F.col("p_size") - F.col("ref.p_size")) <= 5
    status = F.when(same & near, "COMPARABLE").when(same | near, "PARTIAL").otherwise("INCOMPARABLE")
    return p.join(best, "p_brand").where(F.col("p_partkey") != F.col("ref.p_partkey")).select("p_partkey", F.col("ref.p_partkey").alias("reference"), status.alias("status"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def ledger_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(quantile_cont(l_quantity, 0.5), 4) AS q2, round(quantile_cont(l_quantity, 0.75), 4) AS q3 FROM lineitem GROUP BY 1""")
def quartiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.round(F.percentile("l_quantity", p), 4).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))


@query("""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS i FROM (SELECT l_suppkey, l_extendedprice::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)),
    w AS (SELECT l_suppkey, i, v AS centre, n AS size, 1 AS cluster, v, n FROM d WHERE i = 1
        UNION ALL SELECT d.l_suppkey, d.i, CASE WHEN d.v - centre <= 500 THEN (centre * size + d.v * d.n) / (size + d.n) ELSE d.v END, CASE WHEN d.v - centre <= 500 THEN size + d.n ELSE d.n END,
            CASE WHEN d.v - centre <= 500 THEN cluster ELSE cluster + 1 END, d.v, d.n FROM w JOIN d ON d.l_suppkey = w.l_suppkey AND d.i = w.i + 1)
    SELECT l_suppkey, sum(n)::BIGINT AS members, min(v) AS least, max(v) AS greatest FROM w GROUP BY l_suppkey, cluster""")
def tolerance_clusters(spark, sf_dir):
    return ordered.tolerance_clusters(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", 500.0)


@query("""WITH k AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'CJK' WHEN regexp_matches(text, '[A-Za-z]') THEN 'LATIN' ELSE 'NONE' END AS script FROM documents) SELECT script, count(*) AS documents FROM k GROUP BY 1""")
def script_census(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(textual.script_of(F.col("text")).alias("script")).groupBy("script").agg(F.count("*").alias("documents"))
