"""Registered queries of the training-data operators, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecraft.llm import fingerprints, html_extract, license_scan, line_dedup, mixing, near_dedup, packing, quality_rules, reply_trees, resampling, spelling, substring_dedup, warc_zip
from zonecraft.session import spread, tune

QUERIES, SQL = {}, {}
WORDS_6 = r"[x for x in regexp_split_to_array({}, '[\x20\x09-\x0D]+') if x <> '']"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(tune(spark), folder)
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# ---- op1: licence scan ------------------------------------------------------------------------

def _license_sql() -> str:
    index = license_scan.Index()
    q = lambda s: "'" + s + "'"
    phrases = ", ".join(f"({q(p)}, {q(label)}, {len(p.split())})" for p, label in license_scan.BASE.items())
    first = len(index.whole)
    postings = ", ".join(f"({q(w)}, {t - first}, {p}, {v})" for w, t, p, v in index.postings if t >= first)
    notices = ", ".join(f"({i}, {q(label)}, {index.full[i]}, [{', '.join(map(q, keys))}])" for i, (label, _, keys) in enumerate(license_scan.NOTICES))
    return rf"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
phrases(phrase, label, n) as (values {phrases}),
postings(word, t, p, v) as (values {postings}),
notices(t, label, total, keys) as (values {notices}),
places as (select doc_id, label, i - 1 as start from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) x, phrases
           where w[i] = split_part(phrase, ' ', 1) and array_to_string(w[i:i + n - 1], ' ') = phrase),
base as (select doc_id, count(*)::bigint as n_base, min(start)::bigint as first_word, max(start)::bigint as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by 1),
words as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i from d),
votes as (select doc_id, t, i - p as at, sum(v) as v from words join postings using (word) group by all),
passages as (select doc_id, label, v::double / total as share from votes join notices using (t) join d using (doc_id)
             where v >= 0.8::double * total and len([k for k in keys if not contains(' ' || array_to_string(w, ' ') || ' ', ' ' || k || ' ')]) = 0),
own as (select doc_id, max(share) as share from passages group by 1),
labels as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from places union all select doc_id, label from passages) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from d left join base using (doc_id) left join own using (doc_id) left join labels using (doc_id)
"""


@query("op1_license_scan", _license_sql())
def op1(spark, folder):
    found = license_scan.scanned(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "__scan.*")
    base = F.transform("places", lambda p: p.label)
    every = F.array_union(base, F.transform("passages", lambda p: p.label))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
                        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), "score")


# ---- op2, op3 ---------------------------------------------------------------------------------

@query("op2_packing")
def op2(spark, folder):
    found = packing.packed(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path(), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op3_fingerprints")
def op3(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    ranges = fingerprints.ranges_for(docs.select("doc_id"), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = fingerprints.compared(docs, ranges)
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
                        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


# ---- op4: near-duplicates ---------------------------------------------------------------------

# Words and 2-word shingles, links by counting common shingles, smallest reachable id.
OP4 = rf"""
with recursive w as (select doc_id, {WORDS_6.format(LOWER)} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
        else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select x, y from p union all select y, x from p),
r as (select doc_id, doc_id as seen from s union select r.doc_id, l.y from r join l on l.x = r.seen)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select doc_id, min(seen) as component_id from r group by doc_id) c using (doc_id)
"""


@query("op4_minhash_dedup", OP4)
def op4(spark, folder):
    found = near_dedup.classes(table(spark, folder, "documents").select("doc_id", "text"), k=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


# ---- op5: HTML extraction ---------------------------------------------------------------------

@query("op5_html_extraction")
def op5(spark, folder):
    return html_extract.extracted(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


# ---- op6: quality rules -----------------------------------------------------------------------

OP6 = rf"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, {WORDS_6.format("coalesce(text, '')")} as w from documents),
l as (select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from w) x where regexp_matches(line, '[^\x20\x09-\x0D]')),
lc as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l group by 1),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w) x),
t as (select doc_id, g from g group by 1, 2 having count(*) > 1),
rc as (select doc_id, count(distinct i + k) as n_repeat_words from g join t using (doc_id, g), range(0, 8) r(k) group by 1),
q as (select doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
      from w left join lc using (doc_id) left join rc using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from q),
m as (select doc_id, lang, source, unnest(['symbols', 'word_length', 'dup_lines']) as measure,
        unnest([1000 * n_symbols // n_words, 100 * word_chars // n_words, 1000 * n_dup_lines // n_lines]) as v from b where not base_failed),
k as (select lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as v, count(*) as c from m group by all),
lv as (select 0 as level, lang, source, measure, v, c from k
       union all select 1, lang, null, measure, v, sum(c) from k group by lang, measure, v
       union all select 2, null, null, measure, v, sum(c) from k group by measure, v),
u as (select *, sum(c) over (partition by level, lang, source, measure order by v) as upto, sum(c) over (partition by level, lang, source, measure) as n from lv),
f as (select level, lang, source, measure, max(n) as n, min(v) filter (4 * upto >= n) as q1, min(v) filter (4 * upto >= 3 * n) as q3 from u group by all),
bt as (select k.lang, k.source, k.measure, min({{'level': f.level, 'q1': f.q1, 'q3': f.q3}}) as s
       from (select distinct lang, source, measure from k) k join f on f.measure = k.measure and (f.n >= 50 or f.level = 2)
         and (f.level = 2 or f.lang is not distinct from k.lang) and (f.level > 0 or f.source is not distinct from k.source) group by all),
bad as (select distinct doc_id from m join bt on m.lang is not distinct from bt.lang and m.source is not distinct from bt.source and m.measure = bt.measure
        where m.v > s.q3 + 3 * (s.q3 - s.q1) + case m.measure when 'dup_lines' then 400 else 100 end
           or m.measure = 'word_length' and m.v < s.q1 - 3 * (s.q3 - s.q1) - 100)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null as kept
from b left join bad using (doc_id)
"""


@query("op6_quality_rules", OP6)
def op6(spark, folder):
    found = quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in quality_rules.COUNTS[:5]], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


# ---- op7: mixing ------------------------------------------------------------------------------

OP7 = rf"""
with d as (select doc_id, source, len({WORDS_6.format("coalesce(text, '')")})::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as turn from d group by source),
w as (select source, source_size, 2 * source_size as bound, case turn when 0 then 5 when 1 then 2 else 1 end as weight from s),
x as (select *, sum(source_size) over () * 150 / 100::double - (sum(bound) over soon - bound) as rest, sum(weight) over () - (sum(weight) over soon - weight) as weights
      from w window soon as (order by bound::double / weight, source nulls last)),
y as (select *, rest / weights as level from x),
z as (select *, first(case when level * weight <= bound then level end ignore nulls) over (order by bound::double / weight, source nulls last rows between unbounded preceding and current row) as top from y),
t as (select source, source_size, case when top is null then bound::double else least(top * weight, bound::double) end as target from z),
h as (select t.*, case when source_size > 0 then target / source_size else 0 end as each,
        list_sum([(instr('0123456789abcdef', substr(md5('11:' || coalesce(source, chr(0))), i, 1)) - 1)::double * (16 ** (8 - i)) for i in range(1, 9)]) / 4294967296.0::double as u from t),
r as (select doc_id, size, source_size, target, each, u, row_number() over (partition by d.source
        order by (size >> greatest(length(bin(size)) - 4, 0)) << greatest(length(bin(size)) - 4, 0), substr(md5(doc_id::varchar), 1, 2), size, doc_id) as rank
      from d join h on d.source is not distinct from h.source)
select doc_id, size, source_size, target, (size * least(floor(each * rank + u) - floor(each * (rank - 1) + u), 2))::bigint as taken from r
"""


@query("op7_mixing", OP7)
def op7(spark, folder):
    found = mixing.drawn(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                        (F.col("__size") * F.col("__copies")).alias("taken"))


# ---- op8: line dedup --------------------------------------------------------------------------

OP8 = """
with l as (select doc_id, source, lang, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
n as (select source, lang, count(*) as n from documents group by 1, 2),
c as (select source, lang, trim(line, ' ') as line, count(distinct doc_id) as c from l where trim(line, ' ') <> '' group by 1, 2, 3),
b as (select c.source, c.lang, c.line, true as bad from c join n on c.source is not distinct from n.source and c.lang is not distinct from n.lang where c.c >= 5 and c.c > 0.05::double * n.n),
k as (select doc_id, string_agg(l.line, chr(10) order by i) filter (bad is null) as text, count(*) as n_lines, count(bad) as n_dropped
      from l left join b on l.source is not distinct from b.source and l.lang is not distinct from b.lang and trim(l.line, ' ') = b.line group by doc_id)
select doc_id, d.source, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(n_dropped, 0)::bigint as n_dropped
from documents d left join k using (doc_id)
"""


@query("op8_line_dedup", OP8)
def op8(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return line_dedup.without_boilerplate(docs).select("doc_id", "source", "text", F.col("__dropped").alias("n_dropped"))


# ---- op9: substring dedup ---------------------------------------------------------------------

@query("op9_substring_dedup")
def op9(spark, folder):
    found = substring_dedup.repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "paragraph", "n_words", F.col("first_id").alias("first_doc_id"), "first_paragraph", "removed")


# ---- op10: WARC in ZIP ------------------------------------------------------------------------

OP10 = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type, case when page_id <> first then first end as refers_to
from p left join f using (payload_digest)
"""


@query("op10_warc_zip", OP10)
def op10(spark, folder):
    found = warc_zip.round_trip(table(spark, folder, "pages"))
    digest = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("digest"))
    return found.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


# ---- op11: chat formatting --------------------------------------------------------------------

# The length of the text that the template writes; control strings get a backslash behind their first character.
CONTROL = r"([<\[])(\\*)(/?s>|pad>|unk>|<SYS>>|</SYS>>|\|[A-Za-z0-9_]+\|>|/?INST\])"
OP11 = rf"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '{CONTROL}', '\1\2_\3', 'g') || '<|im_end|>' || chr(10)))::bigint as formatted_chars
from c group by conv_id
"""


@query("op11_chat_formatting", OP11)
def op11(spark, folder):
    ok = "</s>[INST] ok [/INST]"
    trial = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(trial)
    paths = reply_trees.branches(reply_trees.turn_links(turns, "conv_id", "turn"))
    found = reply_trees.round_trip(turns, paths, "conv_id", "turn")
    return found.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


# ---- op12: spelling variants ------------------------------------------------------------------

# The CRC-32 of the bytes of x but for the last inversion, one step per byte, with a table of the steps of all bytes.
CRC = """list_reduce(list_prepend(4294967295::bigint, [(instr('0123456789ABCDEF', substr(hex(encode(x)), 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode(x)), 2 * i, 1)) - 1
  for i in range(1, octet_length(encode(x)) + 1)]), lambda s, b: xor(s >> 8, st[(xor(s, b) & 255) + 1]))"""
STEPS = "steps as materialized (select list(v order by k) as st from (select k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, b: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end) as v from range(256) r(k)) t)"
OP12 = rf"""
with recursive {STEPS},
r as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as w from documents) t),
g as (select doc_id, w, doc_id || ':' || w as x, count(*) as c from r group by all),
h as (select w, c, xor({CRC}, 4294967295) as h from g, steps),
e as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, c from h),
v as materialized (select word, sum(c)::bigint as n from e where length(word) >= 6 group by 1 having sum(c) >= 5),
d as materialized (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from (select word, n, unnest(range(1, length(word) + 1)) as i from v) p),
near as (select d.word, o.word as other, o.n as m from d join d o on d.i = o.i and d.a = o.a and d.b = o.b and d.word <> o.word
         union select d.word, v.word, v.n from d join v on d.a || d.b = v.word union select v.word, d.word, d.n from d join v on d.a || d.b = v.word),
s as (select word, count(*)::bigint as n_near, min(struct_pack(neg := -m, other := other)) as best from near group by 1),
f as materialized (select v.word, n, coalesce(n_near, 0)::bigint as n_near, case when -best.neg >= 5 * n then best.other end as form, case when -best.neg >= 5 * n then -best.neg end as form_n from v left join s using (word)),
walk as (select word, form as here, 1 as step from f where form is not null union all select walk.word, f.form, step + 1 from walk join f on f.word = walk.here where f.form is not null),
ends as (select word, max_by(here, step) as root from walk group by 1)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join ends using (word)
"""


@query("op12_spelling_variants", OP12)
def op12(spark, folder):
    counts = spelling.word_counts(table(spark, folder, "documents"), damage=199)
    return spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


# ---- op13: importance resampling --------------------------------------------------------------

OP13 = rf"""
with {STEPS},
w as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
f as materialized (select doc_id, array_to_string(w[i:i + k - 1], ' ') as x, count(*) as c from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w) d, range(1, 4) n(k) where i + k - 1 <= len(w) group by all),
bf as materialized (select array_to_string(w[i:i + k - 1], ' ') as x, count(*) as c from (select w, unnest(range(1, len(w) + 1)) as i from bw) d, range(1, 4) n(k) where i + k - 1 <= len(w) group by all),
a as (select x from f union select x from bf),
h as materialized (select x, xor({CRC}, 4294967295) % 10000 as b from a, steps),
s as (select b, sum(c) as s from f join h using (x) group by 1),
t as (select b, sum(c) as t from bf join h using (x) group by 1),
g as materialized (select k as b, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double) / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint as gain
      from range(10000) r(k) left join s on s.b = k left join t on t.b = k),
wt as (select doc_id, sum(c)::bigint as n_features, sum(c * gain)::bigint as weight from f join h using (x) join g using (b) group by 1),
q as (select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        list_sum([(instr('0123456789abcdef', substr(sha256('42:' || doc_id), i, 1)) - 1)::double * (16 ** (8 - i)) for i in range(1, 9)]) as h from w left join wt using (doc_id)),
z as (select doc_id, n_words, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))))::bigint as score from q),
o as (select doc_id, row_number() over (order by score desc, doc_id)::bigint as rank, count(*) over () as n from z where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= (5 * n) // 100 then rank end as rank from z left join o using (doc_id)
"""


@query("op13_importance_resampling", OP13)
def op13(spark, folder):
    found = resampling.scored(table(spark, folder, "documents").select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
