"""Queries for retrieval and ranking (RT)."""

from pyspark.sql import functions as F

from zonecraft.operators import rank as K
from zonecraft.operators import vectors as V
from zonecraft.plans.registry import query
from zonecraft.session import store


def q(s):
    return s.replace("'", "''")


@query("rt_1", "SELECT doc_id, md5(concat_ws(' ', text, lang, source, 'tag ' || lang)) AS h FROM documents")
def rt_1(t):
    d = t.documents.withColumn("tags", F.array(F.lit("tag"), "lang"))
    return d.select("doc_id", F.md5(K.search_text("text", ["lang", "source", F.array_join("tags", " ")])).alias("h"))


@query("rt_2", """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), c AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT query_id::BIGINT AS query_id, vec_id AS doc_id, (list_cosine_similarity(embedding::DOUBLE[], c) + 1) / 2 AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0.3)
SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE rn <= 20""")
def rt_2(t):
    c = K.centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "query_id")
    return V.vector_scores(t.spread("embeddings"), c, "vec_id", "embedding", 20).withColumn("score", F.round("score", 6))


_STOP = "['" + "', '".join(K.STOP_WORDS) + "']"


def _grams(table, key):
    return f"""(SELECT {key} AS doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM
 (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM {table}))"""


TFIDF_SQL = f"""dt AS (SELECT doc_id, term, count(*) AS tf FROM {_grams('documents', 'doc_id')} GROUP BY 1, 2),
qt AS (SELECT doc_id AS query_id, term, count(*) AS tf FROM {_grams('benchmark', 'item_id')} GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS tot, count(*) AS df FROM dt GROUP BY 1), i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v),
dw0 AS (SELECT doc_id, term, tf * idf AS w FROM dt JOIN i USING (term)), dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0),
qw0 AS (SELECT query_id, term, tf * idf AS w FROM qt JOIN i USING (term)), qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw0),
sc AS (SELECT query_id, doc_id, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (term) GROUP BY 1, 2)"""


def keyword(t, threshold, top=None):
    docs = t.spread("documents")
    counts, n = K.term_counts(docs, "doc_id", "text", hashed=True), t.documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return K.keyword_matches(counts, K.term_counts(t.benchmark, "item_id", "text", hashed=True), n, threshold, top)


@query("rt_3", f"WITH {TFIDF_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM sc WHERE score > 0.1")
def rt_3(t):
    return keyword(t, 0.1).withColumn("score", F.round("score", 6))


@query("rt_3_top", f"""WITH {TFIDF_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM sc WHERE score > 0.05)
SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE rn <= 10""")
def rt_3_top(t):
    return keyword(t, 0.05, 10).withColumn("score", F.round("score", 6))


@query("rt_4", """
WITH d AS (SELECT doc_id, lower(lang) AS environment, lower(source) AS service, CASE WHEN n_chars > 3000 THEN 'high' ELSE 'low' END AS severity FROM documents)
SELECT doc_id, round((CASE WHEN service = 'src1' THEN 1.0 WHEN contains(service, 'src1') OR contains('src1', service) THEN 0.5 ELSE 0.0 END + CASE WHEN environment = 'en' THEN 1.0 WHEN contains(environment, 'en') OR contains('en', environment) THEN 0.5 ELSE 0.0 END
 + CASE WHEN severity = 'high' THEN 1.0 WHEN contains(severity, 'high') OR contains('high', severity) THEN 0.5 ELSE 0.0 END) / 3, 6) AS score, 0.1::DOUBLE AS without_query FROM d""")
def rt_4(t):
    d = t.documents.select("doc_id", F.col("lang").alias("environment"), F.col("source").alias("service"), F.when(F.col("n_chars") > 3000, "high").otherwise("low").alias("severity"))
    return d.select("doc_id", F.round(K.metadata_score({"service": "SRC1", "environment": "en", "severity": "high"}), 6).alias("score"), K.metadata_score({}).alias("without_query"))


# incidents: conversation turns with a typical complaint appended by role and turn
TAILS = [("role = 'system'", " Kubernetes pod: web-1 crash, error code: 5003, restart needed, P1 outage"),
         ("turn = 1", " VM instance db-vm-7 is down in us-central1-a, terminated, please start"), ("turn = 2", " database: orders_db connection timeout, urgent"),
         ("turn = 3", " disk full on gcp storage, increase capacity; memory oom"), ("turn = 4", " firewall permission denied, unauthorized access attack")]
INC = "inc AS (SELECT conv_id, turn, text || CASE " + " ".join(f"WHEN {c} THEN '{q(s)}'" for c, s in TAILS) + " ELSE '' END AS text, CASE turn % 4 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE '4' END AS priority FROM conversations)"


def incidents(t):
    tail = None
    for c, s in TAILS:
        tail = F.when(F.expr(c), s) if tail is None else tail.when(F.expr(c), s)
    p = F.col("turn") % 4
    return t.spread("conversations").select("conv_id", "turn", F.concat("text", tail.otherwise("")).alias("text"), F.when(p == 0, "1").when(p == 1, "3").otherwise("4").alias("priority"))


SCRIPTS = [
    {"id": "start-vm", "service": "gcp", "category": "compute", "action": "restart", "keywords": ["vm", "instance", "start", "down"], "error_patterns": ["terminated", "stopped"],
     "incident_patterns": ["vm instance", "is down"], "required_inputs": ["instance_name", "zone"], "risk_level": "low", "description": "start a stopped instance"},
    {"id": "restart-pod", "service": "kubernetes", "category": "containers", "action": "restart", "keywords": ["pod", "restart", "crash"], "error_patterns": ["crash", "oom"],
     "incident_patterns": ["pod", "crash"], "required_inputs": ["pod_name"], "risk_level": "medium", "description": "restart a crashing pod"},
    {"id": "scale-disk", "service": "storage", "category": "storage", "action": "scale", "keywords": ["disk", "capacity"], "error_patterns": ["disk full"],
     "incident_patterns": ["disk full"], "required_inputs": [], "risk_level": "high", "description": "grow a volume"},
    {"id": "stop-db", "service": "database", "category": "database", "action": "repair", "keywords": ["database", "timeout", "connection"], "error_patterns": ["timeout", "refused"],
     "incident_patterns": ["connection timeout"], "required_inputs": ["database_name", "error_code"], "risk_level": "critical", "description": "fail over and stop a database"},
]


def _contains(c, phrases, op=" + "):
    return "(" + op.join(f"CAST(contains({c}, '{q(p.lower())}') AS INTEGER)" for p in phrases) + ")" if phrases else "0"


def _intent_sql(c="lower(text)"):
    return "list_max([" + ", ".join(f"{{'s': {_contains(c, kws)} / {len(kws)}, 'o': -{i}, 'intent': '{k}'}}" for i, (k, kws) in enumerate(K.INTENTS.items())) + "])"


def _service_sql(c="lower(text)"):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches({c}, '{q(p)}')" for p in pats) + f" THEN '{k}'" for k, pats in K.SERVICES.items()) + " END"


def _entity_sql(name):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){q(p)}', 1), '')" for p in K.ENTITIES[name]) + ")"


_UNDER = f"""u AS (SELECT conv_id, turn, text, {_intent_sql()} AS b, {_service_sql()} AS service, {', '.join(f'{_entity_sql(n)} AS {n}' for n in K.ENTITIES)} FROM inc)"""


def _script_meta_sql(s):
    svc, n = s["service"], len(s["error_patterns"])
    req = " + ".join(f"CAST({r} IS NOT NULL AS INTEGER)" for r in s["required_inputs"]) or "0"
    got = (f"CASE WHEN service IS NULL THEN 0.0 WHEN service = '{svc}' THEN 1.0 WHEN contains('{svc}', service) OR contains(service, '{svc}') THEN 0.5 ELSE 0.0 END + CASE WHEN intent <> 'unknown' AND contains('{s['action']}', intent) THEN 1.0 ELSE 0.0 END"
           f" + 0.5 * ({req}) + least({_contains('lower(text)', s['error_patterns'])} / {n}, 1.0)")
    top = f"CASE WHEN service IS NULL THEN 0.0 ELSE 1.0 END + CASE WHEN intent <> 'unknown' THEN 1.0 ELSE 0.0 END + 0.5 * ({req}) + 1.0"
    return f"SELECT conv_id, turn, '{s['id']}' AS script_id, round(({got}) / ({top}), 6) AS score FROM w"


@query("rt_5", f"WITH {INC}, {_UNDER}, w AS (SELECT *, CASE WHEN b.s > 0 THEN b.intent ELSE 'unknown' END AS intent FROM u) " + " UNION ALL ".join(_script_meta_sql(s) for s in SCRIPTS))
def rt_5(t):
    x = K.understand(incidents(t), "text").withColumn("_e", F.map_keys("entities"))
    rows = [F.struct(F.lit(s["id"]).alias("script_id"), F.round(K.script_metadata_score(s, F.col("text"), F.col("service"), F.col("intent"), F.col("_e")), 6).alias("score")) for s in SCRIPTS]
    return x.select("conv_id", "turn", F.inline(F.array(*rows)))


@query("rt_6", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS ok, avg(value) FILTER (WHERE event_type <> 'error' AND value > 0) AS t, max(ts) AS last FROM r WHERE rn <= 50 GROUP BY 1),
s AS (SELECT *, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) / 8.64e10) AS d FROM g)
SELECT user_id AS script_id, ok AS fixed_count, round(ok / n, 6) AS success_rate, round(t, 8) AS avg_resolution_time, round(greatest(0.0, 1 - d / 30), 6) AS recency,
 round(greatest(0.1, 0.4 * least(ok / 20, 1.0) + 0.3 * ok / n + 0.2 * CASE WHEN t > 0 THEN greatest(0.0, 1 - t / 60) ELSE 0.5 END + 0.1 * greatest(0.0, 1 - d / 30)), 6) AS score FROM s""")
def rt_6(t):
    r = t.events.select(F.col("user_id").alias("script_id"), F.col("event_id").alias("execution_id"), F.col("ts").alias("executed_at"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("resolution_time"))
    x = K.history_scores(r, "2024-01-31", last=50)
    return x.select("script_id", "fixed_count", F.round("success_rate", 6).alias("success_rate"), F.round("avg_resolution_time", 8).alias("avg_resolution_time"), F.round("recency", 6).alias("recency"), F.round("score", 6).alias("score"))


def _fixes(t):
    return t.lineitem.select(F.col("l_orderkey").alias("incident_id"), F.col("l_suppkey").alias("script_id"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_quantity").alias("resolution_time"),
                             F.col("l_shipdate").alias("executed_at"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("fix_id"), "l_linenumber", "l_partkey")


@query("rt_7", """SELECT l_suppkey AS script_id, count(*) AS fixed_count, round(avg(l_quantity), 8) AS avg_resolution_time, count(DISTINCT l_orderkey) AS incidents, least(count(*) / 10, 1.0)::DOUBLE AS score
FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') GROUP BY 1""")
def rt_7(t):
    sim = t.orders.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("incident_id"))
    return K.fixers(sim, _fixes(t)).withColumn("avg_resolution_time", F.round("avg_resolution_time", 8))


@query("rt_8", """WITH r AS (SELECT o_orderpriority AS service, l_shipdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY l_shipdate DESC, l_orderkey, l_suppkey) AS position, l_orderkey AS incident_id, l_suppkey AS script_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R')
SELECT service, incident_id, script_id, position, strftime(l_shipdate, '%Y-%m-%d') AS executed FROM r WHERE position <= 5""")
def rt_8(t):
    inc = t.orders.select(F.col("o_orderkey").alias("incident_id"), F.col("o_orderpriority").alias("service"))
    x = K.similar_resolved(inc, _fixes(t), ["service"])
    return x.select("service", "incident_id", "script_id", F.col("position").cast("long").alias("position"), F.date_format("executed_at", "yyyy-MM-dd").alias("executed"))


# votes: each event rates a document (its floor value) for a query (its user) on behalf of a ranker (its type)
VOTES = """vt AS (SELECT user_id AS query_id, CAST(floor(value / 4) AS BIGINT) AS doc_id, CASE event_type WHEN 'click' THEN '{a}' WHEN 'view' THEN 'keyword' WHEN 'error' THEN 'graph' WHEN 'signup' THEN 'metadata' ELSE '{a}' END AS agent, max(round(value / 250, 6)) AS score FROM events GROUP BY 1, 2, 3)"""


def votes(t, first):
    e = F.col("event_type")
    a = F.when(e == "view", "keyword").when(e == "error", "graph").when(e == "signup", "metadata").otherwise(first)
    return t.events.groupBy(F.col("user_id").alias("query_id"), F.floor(F.col("value") / 4).alias("doc_id"), a.alias("agent")).agg(F.max(F.round(F.col("value") / 250, 6)).alias("score"))


def _w(i):
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in K.WEIGHTS.items()) + " END"


@query("rt_9", f"""WITH {VOTES.format(a='semantic')}, w AS (SELECT query_id, doc_id, coalesce(max(score) FILTER (WHERE agent = 'semantic'), 0) AS s, coalesce(max(score) FILTER (WHERE agent = 'keyword'), 0) AS k, coalesce(max(score) FILTER (WHERE agent = 'metadata'), 0) AS m, coalesce(max(score) FILTER (WHERE agent = 'graph'), 0) AS g FROM vt GROUP BY 1, 2),
x AS (SELECT w.*, CASE query_id % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'database' ELSE 'default' END AS kind, CASE WHEN query_id % 2 = 0 THEN 0.05 ELSE 0.0 END AS sh FROM w),
f AS (SELECT query_id, doc_id, ({_w(0)} - sh) * s + {_w(1)} * k + ({_w(2)} + sh) * m + {_w(3)} * g AS score FROM x) SELECT query_id, doc_id, round(score, 8) AS score FROM f WHERE score > 0.1""")
def rt_9(t):
    v = votes(t, "semantic")
    x = K.combine_scores({a: v.filter(F.col("agent") == a) for a in K.AGENTS})
    k = F.col("query_id") % 3
    x = x.withColumns({"kind": F.when(k == 0, "Security").when(k == 1, "database").otherwise("unheard"), "sev": F.when(F.col("query_id") % 2 == 0, "high").otherwise("low")})
    return K.weighted_fusion(x, K.fusion_weights("kind", "sev")).select("query_id", "doc_id", F.round("score", 8).alias("score"))


_RRF = f"""{VOTES.format(a='vector')}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, agent ORDER BY score DESC, doc_id) AS rank FROM vt WHERE score > CASE agent WHEN 'keyword' THEN 0.05 ELSE 0.1 END),
fu AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS s, count(DISTINCT agent) AS agents, min(rank) AS best_rank FROM rk GROUP BY 1, 2)"""


@query("rt_10", f"WITH {_RRF} SELECT query_id, doc_id, round(s, 9) AS rrf_score, agents, best_rank FROM fu")
def rt_10(t):
    return K.rrf(votes(t, "vector")).withColumn("rrf_score", F.round("rrf_score", 9))


@query("rt_11", f"WITH {_RRF} SELECT query_id, doc_id, agents FROM fu WHERE agents >= 2 AND s >= 0.03")
def rt_11(t):
    return K.rrf(votes(t, "vector"), min_agents=2).filter("rrf_score >= 0.03").select("query_id", "doc_id", "agents")


@query("rt_12", f"WITH {VOTES.format(a='vector')} SELECT query_id, count(*) AS n, round(least(1.0, 0.3 * least(count(*) / 5, 1.0) + 0.4 * least(avg(score), 1.0) + 0.3 * least(max(score), 1.0)), 8) AS confidence FROM vt GROUP BY 1")
def rt_12(t):
    return K.list_confidence(votes(t, "vector")).withColumn("confidence", F.round("confidence", 8))


def _eval_sql():
    rows = []
    for i, s in enumerate(SCRIPTS):
        kw, pt = _contains("lower(text)", s["keywords"]), _contains("lower(text)", s["incident_patterns"])
        base = K.RISK_SCORE[s["risk_level"]]
        safe = f"CASE WHEN priority IN ('1', '2') THEN least(1.0, {base} + 0.1) ELSE {base} END" if s["risk_level"] in ("low", "medium") else str(base)
        rows.append(f"SELECT conv_id, turn, {i} AS i, '{s['id']}' AS script_id, '{s['risk_level']}' AS risk, round(least(1.0, least(0.3, {kw} * 0.1) + least(0.5, {pt} * 0.2)), 9)::DOUBLE AS sem, ({safe})::DOUBLE AS safe,"
                    f" round(least(1.0, 0.5 + 0.1 * least({pt}, 3) + 0.05 * least({kw}, 4)), 9)::DOUBLE AS ctx, (least(0.95, 0.5 + 0.1 * {kw} + 0.15 * {pt}) + 0.9 + 0.7) / 3 AS conf FROM inc")
    return " UNION ALL ".join(rows)


@query("rt_13", f"""WITH {INC}, ev AS ({_eval_sql()}),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sem DESC, i) AS r1, row_number() OVER (PARTITION BY conv_id, turn ORDER BY safe DESC, i) AS r2, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ctx DESC, i) AS r3 FROM ev),
fu AS (SELECT *, 1.0 / (60 + r1) + 1.0 / (60 + r2) + 1.0 / (60 + r3) AS rrf FROM rk), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(rrf, 12) DESC, i) AS n FROM fu)
SELECT conv_id, turn, script_id, risk, round(rrf, 9) AS rrf, round(conf, 6) AS confidence, risk IN ('high', 'critical') OR (rrf < 0.02 AND conf < 0.5) AS needs_approval, risk IN ('low', 'medium') AND NOT (rrf < 0.02 AND conf < 0.5) AND rrf >= 0.03 AS approved FROM b WHERE n = 1""")
def rt_13(t):
    x = K.evaluate_scripts(incidents(t), SCRIPTS, ["conv_id", "turn"], "text", "priority")
    return x.select("conv_id", "turn", "script_id", "risk", F.round("rrf", 9).alias("rrf"), F.round("confidence", 6).alias("confidence"), "needs_approval", "approved")


def _sev_sql():
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in K.SEVERITIES.items()) + " END"


_QSTOP = "['" + "', '".join(K.QUERY_STOP_WORDS) + "']"
_EXP = " ".join(f"WHEN '{k}' THEN ['{v[0]}', '{v[1]}']" for k, v in K.EXPANSIONS.items())


def _dedup(c):
    return f"list_transform(list_filter(range(1, len({c}) + 1), lambda i: list_position({c}, {c}[i]) = i), lambda i: {c}[i])"


@query("rt_14", f"""WITH {INC}, {_UNDER}, k0 AS (SELECT *, {_sev_sql()} AS severity, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$') AND NOT list_contains({_QSTOP}, x)) AS k FROM u),
k1 AS (SELECT *, ({_dedup('k')})[1:15] AS kw FROM k0), k2 AS (SELECT *, flatten(list_transform(kw, lambda x: CASE x {_EXP} ELSE []::VARCHAR[] END)) AS ex FROM k1)
SELECT conv_id, turn, CASE WHEN b.s > 0 THEN b.intent ELSE 'unknown' END AS intent, round((least(b.s * 2, 1.0) + 0.7) / 2, 6) AS confidence, service, severity, array_to_string(kw, ',') AS keywords, array_to_string(({_dedup('ex')})[1:10], ',') AS expansion,
 instance_name, zone, pod_name, database_name, error_code FROM k2""")
def rt_14(t):
    x = K.understand(incidents(t), "text", keyword_limit=15, synonyms=2, expansion_limit=10)
    e = lambda n: F.element_at("entities", F.lit(n)).alias(n)
    return x.select("conv_id", "turn", "intent", F.round("confidence", 6).alias("confidence"), "service", "severity", F.array_join("keywords", ",").alias("keywords"), F.array_join("expansion", ",").alias("expansion"),
                    e("instance_name"), e("zone"), e("pod_name"), e("database_name"), e("error_code"))


def _hint_sql(k):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in ps) + f" THEN '{v}'" for v, ps in K.HINTS[k]) + f" END AS {k}"


@query("rt_15", f"WITH {INC} SELECT conv_id, turn, {', '.join(_hint_sql(k) for k in K.HINTS)} FROM inc")
def rt_15(t):
    return incidents(t).select("conv_id", "turn", *[c.alias(k) for k, c in K.metadata_hints("text").items()])


@query("rt_16", "SELECT event_id, round(0.6 * CASE WHEN event_type = 'view' THEN value / 300 ELSE value / 500 END + 0.4 * value / 300, 8) AS final_score FROM events")
def rt_16(t):
    f = F.col("value") / 300
    return t.events.select("event_id", F.round(K.final_mix(F.when(F.col("event_type") != "view", F.col("value") / 500), f), 8).alias("final_score"))


@query("rt_17", """SELECT event_id, CASE WHEN r = '' THEN 'General match' ELSE r END AS reasons FROM (SELECT event_id, concat_ws(',', CASE WHEN value / 100 > 0.5 THEN 'High semantic similarity' END, CASE WHEN value / 200 > 0.4 THEN 'Strong keyword match' END,
 CASE WHEN value / 400 > 0.3 THEN 'Metadata alignment' END, CASE WHEN value / 300 > 0.3 THEN 'Historical success' END) AS r FROM events)""")
def rt_17(t):
    v = F.col("value")
    return t.events.select("event_id", F.array_join(K.match_reasons(v / 100, v / 200, v / 400, v / 300), ",").alias("reasons"))


def _lex_sql():
    rows = []
    for i, s in enumerate(SCRIPTS):
        ep = " + ".join(f"CAST(regexp_matches(lower(text), '(?i){q(p)}') AS INTEGER)" for p in s["error_patterns"])
        rows.append(f"SELECT conv_id, turn, {i} AS i, '{s['id']}' AS script_id, round(least({_contains('lower(text)', s['keywords'])} / {len(s['keywords'])}, 1.0) * 0.40 + least(({ep}) / {len(s['error_patterns'])}, 1.0) * 0.35"
                    f" + CASE WHEN contains('{s['category']}', cat) OR contains(cat, '{s['category']}') THEN 0.15 ELSE 0.0 END + CASE WHEN contains(lower(text), '{s['service']}') THEN 0.10 ELSE 0.0 END, 3) AS score FROM c")
    return " UNION ALL ".join(rows)


@query("rt_18", f"""WITH {INC}, c AS (SELECT *, CASE WHEN turn = 3 THEN 'storage' WHEN turn = 2 THEN 'data' ELSE 'compute' END AS cat FROM inc), s AS ({_lex_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) AS position FROM s WHERE score > 0) SELECT conv_id, turn, script_id, score, CAST(position AS INTEGER) AS position FROM r WHERE position <= 3""")
def rt_18(t):
    x = incidents(t).withColumn("cat", F.when(F.col("turn") == 3, "storage").when(F.col("turn") == 2, "data").otherwise("compute"))
    return K.match_scripts(x, SCRIPTS, ["conv_id", "turn"], "text", "cat")


def _boost_sql():
    rows = []
    for s in SCRIPTS:
        ep = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{q(p)}') THEN 0.3 ELSE 0.0 END" for p in s["error_patterns"])
        bonus = 0.5 if "start" in s["id"] else -0.3 if "stop" in s["id"] or "scale" in s["id"] else 0.0
        rows.append(f"SELECT conv_id, turn, '{s['id']}' AS script_id, least(1.0, round(CASE WHEN contains('{s['service']}', cls) OR contains('{s['category']}', cls) OR contains('{s['id']}', cls) THEN 0.4 ELSE 0.0 END"
                    f" + CASE WHEN contains(lower(text), 'terminated') OR contains(lower(text), 'stopped') THEN {bonus} ELSE 0.0 END + 0.2 * {_contains('lower(text)', s['keywords'])} + {ep}"
                    f" + CASE WHEN len(list_filter((list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')), lambda x: contains('{s['description']}', x))) > 0 THEN 0.1 ELSE 0.0 END, 6))::DOUBLE AS score FROM c")
    return " UNION ALL ".join(rows)


@query("rt_18_boosts", f"WITH {INC}, c AS (SELECT *, CASE WHEN turn = 3 THEN 'storage' WHEN turn = 1 THEN 'vm' ELSE 'none' END AS cls FROM inc), s AS ({_boost_sql()}) SELECT * FROM s WHERE score > 0")
def rt_18_boosts(t):
    x = incidents(t).withColumn("cls", F.when(F.col("turn") == 3, "storage").when(F.col("turn") == 1, "vm").otherwise("none"))
    return K.registry_boosts(x, SCRIPTS, ["conv_id", "turn"], "text", "cls")


PROCEDURES = [
    {"id": "SOP-1", "classifications": ["kubernetes", "pod"], "error_keywords": ["crash", "restart"]},
    {"id": "SOP-2", "classifications": ["vm", "instance"], "error_keywords": ["down", "terminated"]},
    {"id": "SOP-3", "classifications": ["database", "disk"], "error_keywords": ["timeout", "full"]},
]


def _sop_sql():
    any_ = lambda xs: "(" + " OR ".join(f"contains(lower(text), '{x}')" for x in xs) + ")"
    return "CASE " + " ".join(f"WHEN {any_(p['classifications'])} AND {any_(p['error_keywords'])} THEN '{p['id']}'" for p in PROCEDURES) + " END"


@query("rt_19", f"""WITH {INC}, e AS (SELECT *, CASE WHEN priority = '1' THEN 'severity P1' WHEN contains(lower(text), 'attack') THEN 'pattern attack' WHEN contains(lower(text), 'breach') THEN 'pattern breach' END AS escalation FROM inc)
SELECT conv_id, turn, escalation, CASE WHEN escalation IS NULL THEN {_sop_sql()} END AS procedure FROM e""")
def rt_19(t):
    x = incidents(t).withColumn("sev", F.concat(F.lit("P"), "priority"))
    return K.first_procedure(x, PROCEDURES, "text", "sev", escalate_patterns=["attack", "breach"]).select("conv_id", "turn", "escalation", "procedure")
