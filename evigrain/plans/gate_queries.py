"""Named queries of gates, language, quantities, references and histories, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import evidence, gates, polarity, quantity, quotes
from ..session import table
from .registry import query

VERBS = {"purchase": "increased", "click": "did not increase", "error": "reduced", "view": "does not affect", "signup": "abolished the rise in"}
CLAIM = "The drug increases growth"


def sentence() -> Column:
    tail = F.when(F.col("event_id") % 4 == 0, ", but others declined").otherwise("")
    return F.concat(F.lit("The drug "), evidence.lookup(VERBS, F.col("event_type")), F.lit(" growth"), tail)


SENTENCE = """s AS (SELECT *, 'The drug ' || CASE event_type WHEN 'purchase' THEN 'increased' WHEN 'click' THEN 'did not increase' WHEN 'error' THEN 'reduced'
    WHEN 'view' THEN 'does not affect' ELSE 'abolished the rise in' END || ' growth' || CASE WHEN event_id % 4 = 0 THEN ', but others declined' ELSE '' END AS t FROM events)"""


@query(f"""WITH {SENTENCE}, n AS (SELECT event_id, len(regexp_extract_all(t, '\\bnot\\b')) AS negations,
        len(list_filter(string_split_regex(regexp_replace(t, '\\b(but|while)\\b', ';\\1', 'g'), '[,;]+'), lambda x: trim(x) <> '')) AS clauses FROM s)
    SELECT event_id, negations, negations % 2 = 1 AS negated, clauses FROM n""")
def sentence_negations(spark, sf_dir):
    n = polarity.net_negations(sentence())
    return table(spark, sf_dir, "events").select("event_id", n.alias("negations"), (n % 2 == 1).alias("negated"), F.size(polarity.clauses(sentence())).cast("long").alias("clauses"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 'CONTRADICTORY'
    WHEN event_id % 4 = 0 THEN CASE event_type WHEN 'purchase' THEN 'UNRESOLVED' ELSE 'CONTRADICTORY' END
    WHEN event_type = 'signup' THEN 'UNRESOLVED' END AS verdict FROM events""")
def claim_polarity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", polarity.check(F.lit(CLAIM), sentence()).alias("verdict"))


@query("""SELECT event_id, 'mass' AS dimension, round(CAST(value AS DECIMAL(12,2))::DOUBLE / 1000, 6) AS base FROM events
    UNION ALL SELECT event_id, 'time', event_id * 60.0::DOUBLE FROM events UNION ALL SELECT event_id, NULL, 7.0::DOUBLE FROM events""")
def quantity_bases(spark, sf_dir):
    said = F.concat(F.lit("took "), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" mg for "), F.col("event_id"), F.lit(" minutes in 7 rounds"))
    q = table(spark, sf_dir, "events").select("event_id", F.explode(quantity.quantities(said)).alias("q"))
    return q.select("event_id", F.col("q.dimension").alias("dimension"), F.round(F.col("q.base").cast("double"), 6).alias("base"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ALIGNED' WHEN 1 THEN 'UNIT_MISMATCH' WHEN 2 THEN 'VALUE_MISMATCH' ELSE 'COMPARATOR_MISMATCH' END AS verdict FROM events""")
def value_alignment(spark, sf_dir):
    i, e = F.col("event_id"), F.col("event_id") % 4
    value = F.concat(F.when(e == 3, "<").otherwise(""), F.lit(1) + i, F.lit(" g"))
    source = F.concat(F.when(e == 3, "a mass >").otherwise("a mass of "), F.when(e == 0, (i + 1) * 1000).when(e == 2, i + 2).otherwise(i + 1), F.when(e == 0, " mg").when(e == 1, " L").otherwise(" g"), F.lit(" was used"))
    return table(spark, sf_dir, "events").select("event_id", quantity.value_found(value, source).alias("verdict"))


STATES = ["N/R", "un-checked", "...", "cited only", "fine", "Not accessible!"]


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NOT_REPORTED' WHEN 1 THEN 'UNCHECKED' WHEN 2 THEN 'UNPARSEABLE' WHEN 3 THEN 'CITED_ONLY' WHEN 5 THEN 'INACCESSIBLE' WHEN 6 THEN 'UNPARSEABLE'
    ELSE CASE event_type WHEN 'error' THEN 'NOT_REPORTED' END END AS class FROM events""")
def evidence_states(spark, sf_dir):
    first = F.get(F.array(*map(F.lit, STATES)), (F.col("event_id") % 7).cast("int"))
    second = F.when(F.col("event_type") == "error", "none").when(F.col("event_type") != "view", "ok")
    return table(spark, sf_dir, "events").select("event_id", gates.non_evidence_class(first, second, nullable=[1]).alias("class"))


@query("""SELECT p_partkey FROM part WHERE lower(p_type) IN ('thesis', 'dissertation') OR regexp_matches(lower(p_name || CASE WHEN p_partkey % 7 = 0 THEN ' PhD Thesis' ELSE ' synthesis' END), '\\bphd thesis\\b')""")
def thesis_works(spark, sf_dir):
    title = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, " PhD Thesis").otherwise(" synthesis"))
    return table(spark, sf_dir, "part").where(gates.is_thesis(F.col("p_type"), title)).select("p_partkey")


@query("""WITH l AS (SELECT event_id, event_id % 8 + 1 AS a, lead(event_id % 8 + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT event_id, CASE WHEN a = 8 OR b = 8 THEN 'UNKNOWN_STATE' WHEN b = a + 1 THEN 'OK' WHEN b <= a THEN 'BACKWARDS' ELSE 'SKIPPED' END AS step FROM l WHERE b IS NOT NULL""")
def lifecycle_steps(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, [*gates.LIFECYCLE, "LOST"])), (F.col("event_id") % 8).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", state.alias("now"))
    e = e.withColumn("then", F.lead("now").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.where("then is not null").select("event_id", gates.lifecycle_step(F.col("now"), F.col("then")).alias("step"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\\b(?:may|might|could|suggest|suggests|suggested|suggesting|possibly|possible|likely|hypothesized|speculate|speculated|preliminary|unconfirmed|putative)\\b')) AS modality,
    len(regexp_extract_all(lower(text), '\\b(?:some|most|all|subset|only|primarily|partially|occasionally|predominantly|minority|majority)\\b')) AS quantifiers,
    regexp_matches(lower(trim(text)), '^(?:this|these|those|they|it|such|the authors|furthermore|moreover|however|in contrast|consequently|therefore|the former|the latter|case\\s+\\d+|step\\s+\\d+)\\b') AS leans FROM conversations""")
def sentence_marks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.sentence_marks(F.col("text")).alias("m")).select("conv_id", "turn", "m.*")


NEIGHBOUR = "n AS (SELECT p_partkey, p_name AS a, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)"


def neighbours(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lag("p_name").over(w).alias("b"))


@query(f"""WITH {NEIGHBOUR}, w AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM n)
    SELECT p_partkey, CASE WHEN b IS NULL THEN 'UNRESOLVED' WHEN a = b THEN 'SAME' WHEN list_sort(x) = list_sort(y) THEN 'UNRESOLVED'
        WHEN len(list_filter(x, lambda v: NOT list_contains(y, v))) > 0 AND len(list_filter(y, lambda v: NOT list_contains(x, v))) > 0 THEN 'DIFFERENT' ELSE 'SAME' END AS verdict FROM w""")
def proposition_alignment(spark, sf_dir):
    return neighbours(spark, sf_dir).select("p_partkey", gates.same_proposition(F.col("a"), F.col("b")).alias("verdict"))


@query(f"""WITH {NEIGHBOUR}, g AS (SELECT *, list_distinct(string_split(b, ' ') || [substr(replace(b, ' ', ''), i, 2) for i in range(1, length(replace(b, ' ', '')))]) AS p,
        string_split(a, ' ') || [substr(replace(a, ' ', ''), i, 2) for i in range(1, length(replace(a, ' ', '')))] AS q FROM n WHERE b IS NOT NULL),
    r AS (SELECT p_partkey, a, b, len(list_filter(p, lambda v: list_contains(q, v))) / len(p) AS share FROM g)
    SELECT p_partkey, CASE WHEN contains(a, b) THEN 'EXACT' WHEN contains(b, a) THEN 'FRAGMENT' WHEN share >= 0.85 THEN 'OVERLAP' ELSE 'KEYWORD_ONLY' END AS how,
        round(CASE WHEN contains(a, b) THEN 1 WHEN contains(b, a) THEN length(a) / length(b) ELSE share END, 6)::DOUBLE AS ratio FROM r""")
def quote_support(spark, sf_dir):
    n = neighbours(spark, sf_dir).where("b is not null").select("p_partkey", gates.quote_support(F.col("a"), F.col("b")).alias("s"))
    return n.select("p_partkey", F.col("s.how").alias("how"), F.round("s.ratio", 6).alias("ratio"))


@query("SELECT c_custkey, 'find customer ' || c_custkey || ' now' AS query FROM customer")
def outbound_queries(spark, sf_dir):
    raw = F.concat(F.lit("  find C:\\home\\x.txt SECRET customer "), F.col("c_custkey"), F.lit("  file:///a/b now "))
    return table(spark, sf_dir, "customer").select("c_custkey", gates.outbound_query(raw, ["secret"]).alias("query"))


@query("""SELECT o_orderkey, TRY_CAST(regexp_extract('published ' || strftime(o_orderdate, '%d-%m-%Y') || ' vol 12', '\\b(19\\d\\d|20\\d\\d)\\b') AS INTEGER) AS year FROM orders""")
def publication_years(spark, sf_dir):
    raw = F.concat(F.lit("published "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" vol 12"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(raw, r"\b(19\d\d|20\d\d)\b", 1).try_cast("int").alias("year"))


@query("""SELECT DISTINCT p_partkey, unnest([p_type, p_brand, string_split(p_name, ' ')[1]]) AS keyword FROM part""")
def keyword_lists(spark, sf_dir):
    raw = F.concat("p_type", F.lit("; "), "p_brand", F.lit("，, "), F.substring_index("p_name", " ", 1), F.lit("|"), "p_type", F.lit(" ;"))
    words = F.array_distinct(F.filter(F.transform(F.split(raw, r"[;,，；|]"), lambda w: F.trim(w)), lambda w: w != ""))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(words).alias("keyword"))


@query("""SELECT event_id, unnest(list_distinct([CAST(json_extract_string(props, '$.k') AS DOUBLE), CAST(value AS DECIMAL(12,2))::DOUBLE])) AS number FROM events""")
def numeric_tokens(spark, sf_dir):
    raw = F.concat(F.col("props"), F.lit(" at "), F.col("value").cast("decimal(12,2)").cast("string"))
    found = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(found).alias("number"))


@query("SELECT item, count(*) AS rows FROM (SELECT p_name AS item FROM part UNION ALL SELECT p_type FROM part) GROUP BY item HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("item")).unionByName(p.select(F.col("p_type").alias("item"))).groupBy("item").agg(F.count("*").alias("rows")).where("rows > 1")


@query("""WITH f AS (SELECT *, sum((turn % 3 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations)
    SELECT conv_id, turn FROM f WHERE n % 2 = 0 AND contains(text, 'tion')""")
def lines_outside_fences(spark, sf_dir):
    fences = F.sum((F.col("turn") % 3 == 0).cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    c = table(spark, sf_dir, "conversations").withColumn("__n", fences)
    return c.where((F.col("__n") % 2 == 0) & F.contains("text", F.lit("tion"))).select("conv_id", "turn")


@query("""SELECT 'UNRESOLVED' AS problem, user_id AS id FROM (SELECT DISTINCT user_id FROM events) e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id)
    UNION ALL SELECT 'UNCITED', s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = s_suppkey)""")
def reference_problems(spark, sf_dir):
    refs = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return refs.join(ids, "id", "left_anti").select(F.lit("UNRESOLVED").alias("problem"), "id").unionByName(ids.join(refs, "id", "left_anti").select(F.lit("UNCITED").alias("problem"), "id"))


@query("""SELECT s_suppkey AS id, 'KNOWN' AS status FROM supplier UNION ALL SELECT DISTINCT user_id, 'PENDING' FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def healed_references(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("KNOWN").alias("status"))
    missing = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().join(ids, "id", "left_anti")
    return ids.unionByName(missing.select("id", F.lit("PENDING").alias("status")))


@query("""WITH c AS (SELECT count(DISTINCT s_suppkey) AS total, count(DISTINCT s_suppkey) FILTER (user_id IS NOT NULL) AS cited FROM supplier LEFT JOIN events ON user_id = s_suppkey)
    SELECT total, cited, round(cited / greatest(total, 1), 4) AS coverage FROM c""")
def citation_coverage(spark, sf_dir):
    cited = table(spark, sf_dir, "events").select(F.col("user_id").alias("s_suppkey")).distinct().withColumn("__cited", F.lit(1))
    s = table(spark, sf_dir, "supplier").join(cited, "s_suppkey", "left").agg(F.count("*").alias("total"), F.count("__cited").alias("cited"))
    return s.select("total", "cited", F.round(F.col("cited") / F.greatest(F.col("total"), F.lit(1)), 4).alias("coverage"))


@query("""WITH r AS (SELECT o_custkey % 10 AS source, count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) FILTER (year(o_orderdate) < 1994) AS one FROM orders GROUP BY 1), g AS (SELECT *, (n - one) / greatest(one, 1) AS gain FROM r)
    SELECT source, round(gain, 4) AS gain, CASE WHEN gain >= 0.3 THEN 'DEEP' WHEN gain >= 0.15 THEN 'STANDARD' ELSE 'LOW' END AS label FROM g""")
def marginal_gain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") < 1994).alias("first"))
    per = o.groupBy("o_custkey").agg(F.max(F.col("first").cast("int")).alias("first"))
    r = per.groupBy((F.col("o_custkey") % 10).alias("source")).agg(F.count("*").alias("n"), F.sum("first").alias("one"))
    gain = (F.col("n") - F.col("one")) / F.greatest("one", F.lit(1))
    return r.select("source", F.round(gain, 4).alias("gain"), F.when(gain >= 0.3, "DEEP").when(gain >= 0.15, "STANDARD").otherwise("LOW").alias("label"))


@query("""SELECT l_suppkey, count(*) AS attempts, count(*) FILTER (l_returnflag = 'A') AS acquired, round(count(*) FILTER (l_returnflag = 'A') / count(*), 4) AS rate,
    CASE WHEN count(*) FILTER (l_returnflag <> 'A') = 0 THEN 'COMPLETE' WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 'NONE' ELSE 'PARTIAL' END AS status FROM lineitem GROUP BY 1""")
def acquisition_rates(spark, sf_dir):
    got = F.count_if(F.col("l_returnflag") == "A")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("attempts"), got.alias("acquired"), F.round(got / F.count("*"), 4).alias("rate"), F.when(got == F.count("*"), "COMPLETE").when(got == 0, "NONE").otherwise("PARTIAL").alias("status"))


@query("""SELECT count(*) FILTER (event_type = 'click') AS relations, count(*) FILTER (event_type = 'click' AND value > 50) AS false_relations,
    round(count(*) FILTER (event_type = 'click' AND value > 50) / greatest(count(*) FILTER (event_type = 'click'), 1), 6) AS false_relation_rate FROM events""")
def relation_rates(spark, sf_dir):
    all_, bad = F.count_if(F.col("event_type") == "click"), F.count_if((F.col("event_type") == "click") & (F.col("value") > 50))
    return table(spark, sf_dir, "events").agg(all_.alias("relations"), bad.alias("false_relations"), F.round(bad / F.greatest(all_, F.lit(1)), 6).alias("false_relation_rate"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, arg_max(event_type, struct_pack(c := (event_type = 'signup')::INT, n := n, t := event_type)) AS stratum FROM s GROUP BY 1""")
def primary_stratum(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    order = F.struct((F.col("event_type") == "signup").cast("int"), "n", "event_type")
    return s.groupBy("user_id").agg(F.max_by("event_type", order).alias("stratum"))


@query("""SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value < before""")
def history_breaks(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", "value", F.lag("value").over(w).alias("before")).where("value < before").select("event_id")


@query("""WITH a AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2)
    SELECT user_id, event_type, CASE WHEN b.v IS NULL THEN 'MISSING' WHEN a.v IS NULL THEN 'EXTRA' ELSE 'DIFFERS' END AS divergence FROM a FULL JOIN b USING (user_id, event_type) WHERE a.v IS DISTINCT FROM b.v""")
def replay_divergence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = lambda d, n: d.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias(n))
    both = last(e, "a").join(last(e.where("event_id % 10 <> 0"), "b"), ["user_id", "event_type"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("user_id", "event_type", F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").otherwise("DIFFERS").alias("divergence"))


@query("""SELECT l_orderkey, l_linenumber, 'CMP-' || left(sha256(least(l_partkey::VARCHAR, l_suppkey::VARCHAR) || ':' || greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR)), 8) AS pair_id FROM lineitem""")
def pair_ids(spark, sf_dir):
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("CMP-"), F.left(F.sha2(F.concat_ws(":", F.least(a, b), F.greatest(a, b)), 256), F.lit(8))).alias("pair_id"))


@query("""SELECT conv_id, sha256(string_agg(sha256(turn || ':' || role || ':' || text), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def commit_digests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.sha2(F.concat_ws(":", "turn", "role", "text"), 256).alias("d")).alias("e"))
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["d"]), ""), 256).alias("digest"))


@query("""WITH l AS (SELECT user_id, event_type, epoch_us(ts) AS t, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS u FROM events)
    SELECT user_id, round(sum(u - t) / 1e6, 3) AS wall_seconds, round(coalesce(sum(u - t) FILTER (event_type <> 'view'), 0) / 1e6, 3) AS active_seconds FROM l WHERE u IS NOT NULL GROUP BY 1""")
def active_seconds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "ts", "event_id")
    e = e.withColumn("d", F.lead("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("t")).where("d is not null")
    active = F.coalesce(F.sum(F.when(F.col("event_type") != "view", F.col("d"))), F.lit(0))
    return e.groupBy("user_id").agg(F.round(F.sum("d") / 1e6, 3).alias("wall_seconds"), F.round(active / 1e6, 3).alias("active_seconds"))


@query("""WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 0), b AS (SELECT l_partkey, l_orderkey AS seed, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem JOIN s ON l_orderkey = o_orderkey),
    r AS (SELECT seed, l_partkey FROM b WHERE n <= 3)
    SELECT seed, 'BACKWARD' AS role, l_partkey AS id FROM r UNION SELECT seed, 'FORWARD', l.l_orderkey FROM r JOIN lineitem l ON l.l_partkey = r.l_partkey WHERE l.l_orderkey <> seed""")
def citation_hops(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    seeds = line.where("l_orderkey % 100 = 0").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    first = seeds.withColumn("n", F.row_number().over(w)).where("n <= 3").select(F.col("l_orderkey").alias("seed"), "l_partkey")
    back = first.select("seed", F.lit("BACKWARD").alias("role"), F.col("l_partkey").alias("id"))
    forward = first.join(line, "l_partkey").where("l_orderkey <> seed").select("seed", F.lit("FORWARD").alias("role"), F.col("l_orderkey").alias("id"))
    return back.unionByName(forward).distinct()


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END ELSE 2 END, o_orderkey) AS n
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE n <= 2""")
def question_selection(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    tier = F.when(urgent & (F.col("o_orderstatus") == "O"), 0).when(urgent, 1).otherwise(2)
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(tier, "o_orderkey"))).where("n <= 2").select("o_orderkey")


@query()
def quote_audit(spark, sf_dir):
    """Every turn's quote of the turn before it, sought in that turn and itself; SQL can't follow the cascade."""
    back = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("before", back)
    quote = (
        F.when(F.col("turn") % 4 == 0, F.regexp_replace(F.upper("text"), " ", "  "))
        .when(F.col("turn") % 4 == 1, F.concat(F.left("text", F.lit(2)), F.lit("- "), F.substr("text", F.lit(3))))
        .when(F.col("turn") % 4 == 2, F.concat_ws(" ", "text", F.lit("zzz")))
        .otherwise(F.col("before"))
    )
    found = c.select("conv_id", "turn", quotes.locate(quote, F.concat_ws(" ", "before", "text")).alias("f"))
    return found.select("conv_id", "turn", F.col("f.how").alias("how"), F.round("f.ratio", 6).alias("ratio"))
