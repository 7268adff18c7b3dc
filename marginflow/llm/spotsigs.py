"""Document fingerprints from spot signatures.

Every common word of a text is an anchor; its signature is the anchor with the chain of the next content words after it,
which skips other common words. A fingerprint is the set of a text's signatures, so running prose weighs and layout,
punctuation and case do not. Pairs that are asked for (a text and its edit, a document and the next) are compared by
their exact Jaccard likeness. To find all pairs that are alike, fingerprints are dealt to partitions by set length and
only sets of one or of neighbouring partitions meet, under a rare signature that both must have if they are alike; the
rest is pruned by bounds before sets are compared.

A text without any full chain has one signature, of all its words; a text without words has an empty fingerprint, which
is like another empty one (1) and unlike all others (0). Nulls: a null text is empty; rows with a null doc_id come last in
order. Repeated rows are one document in the order and each keeps its result; a doc_id with several texts stands for
several documents. The successor of a single document is itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import number_rows
from .common import let, staged, text_of

#: Common words of English, French, German and Spanish prose.
ANCHORS = tuple(
    """
    the of and to in is that for it as was with be by on are this from an or at not but his her they have had which a
    le la les de des du et un une en que qui dans pour par sur au aux il elle est pas plus avec ce se sont
    der die das und den von zu mit sich dem auf für ist im nicht ein eine als auch es an werden aus er hat
    el los las del y por con para su lo como más pero sus al o este
    """.split()
)
CHAIN = 3
#: Documents are alike from this likeness on.
LEAST = 0.8


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The fingerprint of a text: its distinct signatures as 32-bit hashes, sorted."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    common = lambda w: w.isin(*ANCHORS)

    def of_words(t):
        anchors = F.filter(F.transform(t, lambda w, i: F.when(common(w), i)), lambda i: i.isNotNull())

        def of_content(c):
            # The j-th anchor at place i has j anchors and i - j content words before it.
            spots = F.filter(F.transform(anchors, lambda i, j: F.struct(i.alias("i"), (i - j).alias("from"))), lambda s: s["from"] + chain <= F.size(c))
            found = F.transform(spots, lambda s: F.hash(F.get(t, s["i"]), F.slice(c, s["from"] + 1, chain)))
            return let(found, lambda s: F.when((F.size(s) == 0) & (F.size(t) > 0), F.array(F.hash(t))).otherwise(s))

        return let(F.filter(t, lambda w: ~common(w)), of_content)

    return F.sort_array(F.array_distinct(let(words, of_words)))


def printed(signature_set: Column) -> Column:
    """A fingerprint as text; equal sets print alike."""
    return F.array_join(signature_set.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints."""
    exact = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both).cast("double"))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(exact)


def length_partition(n: Column, least: float) -> Column:
    """Partitions one factor of 1 / ``least`` wide: sets that are as like as ``least`` lie in one or in neighbours."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1 / least))).cast("int")


def alike(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(print_a, print_b, likeness) of all pairs of different fingerprints that are as like as ``least``, and who has them.

    Equal fingerprints are one class, named by its smallest doc_id. Classes are dealt to partitions by set length. In a
    partition and its upper neighbour a class stands in the lists of its rarest signatures only: two sets as like as
    ``least`` share one of the first n - ceil(least * n) + 1 in any common order. Lengths and the places in the order
    bound a pair before the sets are compared.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(text_of()).alias("_set")).where(F.size("_set") > 0)
    classes = staged(own.groupBy("_set").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("members")).withColumn("_id", F.xxhash64(printed(F.col("_set")))))
    listed = classes.select("_id", F.size("_set").alias("_n"), F.explode("_set").alias("_sign"))
    frequent = listed.groupBy("_sign").agg(F.count(F.lit(1)).alias("_df"))
    place = F.row_number().over(W.partitionBy("_id").orderBy("_df", "_sign"))
    prefix = F.col("_n") - F.ceil(F.lit(least) * F.col("_n")) + 1
    first = staged(listed.join(frequent, "_sign").withColumn("_at", place).where(F.col("_at") <= prefix).withColumn("_part", length_partition(F.col("_n"), least)))
    side = lambda k: first.select("_sign", F.col("_part").alias(f"_part{k}"), F.col("_id").alias(f"_id{k}"), F.col("_n").alias(f"_n{k}"), F.col("_at").alias(f"_at{k}"))
    left = side("a").withColumn("_part", F.explode(F.array(F.col("_parta"), F.col("_parta") + 1)))
    met = left.join(side("b").withColumnRenamed("_partb", "_part"), ["_sign", "_part"])
    # Each pair is met from its lower partition, or inside one from its smaller id.
    once = (F.col("_part") > F.col("_parta")) | (F.col("_ida") < F.col("_idb"))
    most = F.least(F.col("_na") - F.col("_ata"), F.col("_nb") - F.col("_atb")) + F.least("_ata", "_atb")
    short = F.least("_na", "_nb") >= F.lit(least) * F.greatest("_na", "_nb")
    pairs = met.where(once & short & (most * (1 + least) >= F.lit(least) * (F.col("_na") + F.col("_nb")))).select("_ida", "_idb").distinct()
    named = lambda k: classes.select(F.col("_id").alias(f"_id{k}"), F.col("_set").alias(f"_set{k}"), F.col("class").alias(f"class_{k}"), F.col("members").alias(f"members_{k}"))
    judged = pairs.join(named("a"), "_ida").join(named("b"), "_idb").withColumn("likeness", likeness(F.col("_seta"), F.col("_setb"))).where(F.col("likeness") >= least)
    return judged.select("class_a", "class_b", "members_a", "members_b", "likeness", printed(F.col("_seta")).alias("print_a"), printed(F.col("_setb")).alias("print_b"))


def successors(keyed: DataFrame) -> DataFrame:
    """Each document with the next in descending doc_id (after the last: the first), from a distributed numbering."""
    numbered = number_rows(keyed, [F.col("doc_id").desc_nulls_last(), F.col("_b")], "_at")
    total = numbered.count()
    before = F.when(F.col("_at") == 1, F.lit(total)).otherwise(F.col("_at") - 1)
    following = numbered.select(before.alias("_at"), F.col("_a").alias("_next_a"), F.col("_b").alias("_next_b"))
    return numbered.join(following, "_at").drop("_at")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the start of the next document's text.

    Texts are shuffled once by document; that exchange serves both as the next document, which sends the start that is
    asked for and its fingerprint, and as the document itself.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_a"), F.xxhash64(text_of(), F.col("doc_id").isNull()).alias("_b"), text_of().alias("text"), "doc_id")
    rows = texts.select("_a", "_b", "doc_id", F.length("text").cast("long").alias("n_chars"))
    keyed = rows.distinct()
    order = successors(keyed)
    full = texts.select("_a", "_b", "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    asked = order.select("doc_id", "n_chars", F.col("_a").alias("_own_a"), F.col("_b").alias("_own_b"), F.col("_next_a").alias("_a"), F.col("_next_b").alias("_b"))
    heads = asked.join(full, ["_a", "_b"]).select(F.col("_own_a").alias("_a"), F.col("_own_b").alias("_b"), "doc_id", "n_chars", F.substring("text", F.lit(1), half).alias("_head"), signatures(F.col("text")).alias("_next"))
    if keyed.count() < rows.count():
        heads = heads.dropDuplicates(["_a", "_b"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("_head"))
    both = heads.join(full, ["_a", "_b"]).withColumn("_edited", edited)
    own = both.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_next", F.struct(signatures(F.col("text")).alias("own"), signatures(F.col("_edited")).alias("edited")).alias("_sets"))
    # Bound once: the sets are long and each is used several times.
    result = let(F.col("_sets"), lambda s: F.struct(
        printed(s["own"]).alias("fingerprint"), printed(s["edited"]).alias("edited_fingerprint"),
        likeness(s["own"], s["edited"]).alias("near_edited"), likeness(s["own"], F.col("_next")).alias("near_next"),
        F.size(s["own"]).alias("n_signatures"),
    ))
    return own.select("doc_id", "n_chars", "edited_sha256", result.alias("_r")).select("doc_id", "n_chars", "edited_sha256", "_r.*")
