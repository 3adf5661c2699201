"""MinHash near-duplicate removal with min-max signatures.

Every random permutation of the shingle space gives two signature values, its minimum and its
maximum over a document's set, so a signature takes half as many hash evaluations.  Both agree
between two sets with probability equal to their Jaccard similarity; they are negatively
correlated, so the estimate has a lower variance than that of independent minima.  Bands of these
values find candidates, full sets confirm every link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.llm.bitmap import may_match
from zonecraft.llm.components import linked
from zonecraft.llm.minhash import choose_bands, shingle_sets, signatures
from zonecraft.llm.rows import column, whole
from zonecraft.session import store

VALUES, RECALL = 288, 0.99999


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, values: int = VALUES, recall: float = RECALL) -> DataFrame:
    """(id, n, key, component, component_id) for every row of `docs`.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set is the distinct k-word
    shingles of the whole text, of fewer words the whole sequence.  Sets with
    100 |intersection| >= percent |union| are linked; `component` is the smallest set key that can be
    reached, `component_id` the smallest id among its rows.  `values` and `recall` choose the
    bands: the most rows per band with which a pair at the threshold is found with that probability.

    Equal sets are one class before any comparison.  Null or empty texts and texts of white space
    have n = 0, no component, and their own id.  A null id counts as largest: the component takes
    another row's id, or null if none has one.  Repeated rows each get a row.  Other columns of
    `docs` are ignored.  An empty table gives no rows."""
    rows, bands = choose_bands(percent / 100, values, recall, both=True)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = store(signatures(texts, k, rows, bands, both=True))
    keyed = sig.filter("n > 0").withColumn("key", F.struct("a", "b"))
    nodes = store(keyed.groupBy("key").agg(F.min("id").alias("least")))

    def fetch(needed: DataFrame) -> DataFrame:
        one = store(needed.join(nodes, "key"))
        few = may_match(texts, F.xxhash64("id"), one, F.xxhash64("least"))
        found = few.withColumn("row", F.struct("id")).join(one.select("key", F.struct(F.col("least").alias("id")).alias("row")), "row")
        return shingle_sets(found.select("key", "text"), k).dropDuplicates(["key"])

    labels = linked(keyed.select(F.explode("bands").alias("band"), "key"), fetch, percent)
    named = nodes.select("key", "least").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    members = store(named.join(smallest, "label").select("key", F.col("label").alias("component"), "component_id"))
    linked_rows = keyed.select("id", "n", "key").join(members, "key").select("id", "n", "key", "component", "component_id")
    alone = sig.filter("n = 0").select("id", "n", F.lit(None).cast("struct<a:bigint,b:bigint>").alias("key"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("component"), F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with their columns, that stand for their group: those with the smallest id
    of their component, and every row without words.

    Rows are told apart by their id.  Of repeated rows (equal id and text) one stays; other rows with
    the id of a kept row stay too, and rows without id count as one id."""
    found = classes(docs, id_col, text_col, k, percent)
    kept = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.struct("id").alias("who")).distinct()
    rows = docs.select(whole(docs).alias("row"), F.struct(column(id_col).alias("id")).alias("who"), F.xxhash64(column(text_col)).alias("text")).join(kept, "who", "left_semi")
    same = Window.partitionBy("who", "text").orderBy("text")
    return rows.withColumn("n", F.row_number().over(same)).filter("n = 1").select("row.*")
