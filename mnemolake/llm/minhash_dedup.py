"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

Every distinct set of word shingles gets a signature of 64 coordinates and is posted under each (coordinate, value)
pair. Two sets of Jaccard similarity 0.75 agree in 48 coordinates on average and in fewer than 32 about once in
a million, so pairs with at least 32 agreements are kept and then confirmed on the full sets.

* Prefix: a set that must agree 32 times can skip all but its rarest postings: of s shared postings, ordered by how
  many sets hold them, only the first s-31 are merged. Postings of one set only are never merged at all, so most
  documents drop out here, and long posting lists (common passages) are skipped by almost all sets.
* Skip: a pair found in the prefix skips the rest of the lists; its agreements are counted on the two signatures.
* Groups of copies: equal sets are one class from the start. Three rounds link every class or component with the hub
  of its lists that it collides with most, one candidate per component and round, before the remaining lists are
  joined between different components only, and only where the shingles that a set shares with any other suffice. So a
  group of thousands of near copies costs about one comparison per copy, and no pair inside a found component is
  emitted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemolake.llm.components import components
from mnemolake.llm.shared import Memo, Registry, stored, table

registry = Registry()

WORDS = 5
COORDINATES = 64
MATCHES = 32
# where lists are joined in full: coordinates of which only the lowest bit is kept, and the bits that may differ. Sets of
# similarity 0.75 differ in 256 bits on average and in more than 322 about once in 150,000.
LONG = 2048
LONG_DIFFER = 322
# the first bits are compared before the others: 64 of 512 differ on average, more than 102 about once in 500,000
FIRST = 512
FIRST_DIFFER = 102
BLOCK = 2048  # rows of a list that are compared with as many others in one task
STRIP = 256  # rows compared at a time inside a task
PERCENT = 75
STAR_ROUNDS = 3
SKETCH = "n long, set_digest binary, signature array<int>"
_MASK = (1 << 64) - 1


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed 64-bit odd multipliers from a seed."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed) | 1 for i in range(n)], np.uint64)


_PLACES = _odd_numbers(WORDS, 1)
_MULTIPLIERS, _OFFSETS = _odd_numbers(LONG, 2), _odd_numbers(LONG, 3)
_WORD_HASH = Memo(xxhash.xxh64_intdigest, 150_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer than five words is one shingle;
    null, empty and blank texts have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is split and lowered
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORD_HASH.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mix((h * _PLACES[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    rows = len(h) - WORDS + 1
    total = h[:rows] * _PLACES[0]
    for i in range(1, WORDS):
        total += h[i : i + rows] * _PLACES[i]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Per coordinate the smallest of the multiplied hashes' upper halves."""
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):  # bounded memory for very long texts
        block = shingles[at : at + 1024, None] * _MULTIPLIERS[:coordinates] + _OFFSETS[:coordinates]
        np.minimum(low, (block >> np.uint64(32)).astype(np.uint32).min(axis=0), out=low)
    return low.view(np.int32)


def sketch(texts: pd.Series) -> pd.DataFrame:
    """Number of shingles, digest of the set and signature (null without shingles)."""
    rows = []
    for text in texts:
        s = shingle_hashes(text)
        rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s) if len(s) else None))
    return pd.DataFrame(rows, columns=["n", "set_digest", "signature"])


def shingle_set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_hashes(t).view(np.int64) for t in texts], dtype=object)


def long_signature(sets: pd.Series) -> pd.Series:
    """The lowest bits of a longer signature, packed into 64-bit numbers."""
    bits = (signature(np.asarray(s).view(np.uint64), LONG) & 1 for s in sets)
    return pd.Series([np.packbits(b.astype(np.uint8)).view(np.int64) for b in bits], dtype=object)


def posting_prefixes(classes: DataFrame) -> DataFrame:
    """The (``key``, ``node``, ``n``, ``shared``) postings that must be merged; a key is a (coordinate, value) pair.

    ``shared`` is the number of the node's coordinate values that some other set has too.
    """
    posted = classes.select("node", "n", F.posexplode("signature").alias("c", "v")).select(
        "node", "n", (F.shiftleft(F.col("c").cast("long"), 32) + (F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key")
    )
    common = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = posted.join(common, "key")
    per_node = shared.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("k"))
    needed = per_node.filter(F.size("k") >= MATCHES)
    prefix = F.slice("k", F.lit(1), F.size("k") - (MATCHES - 1))
    return needed.select("node", "n", F.size("k").alias("shared"), F.explode(prefix).alias("p")).select("node", "n", "shared", F.col("p.key").alias("key"))


def _alike(a: Column, b: Column) -> Column:
    """At least ``MATCHES`` equal coordinates."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= MATCHES


def _compare(small: pd.DataFrame, large: pd.DataFrame, key: int) -> list[tuple[int, int]]:
    """Pairs of one list that may be links, the smaller set first; a pair comes from the smallest key both have."""
    n, node, root, mass = (large[c].to_numpy() for c in ("n", "node", "root", "mass"))
    bits = np.stack(large["long"].to_list()).view(np.uint64)
    bits_small = np.stack(small["long"].to_list()).view(np.uint64)
    words = FIRST // 64
    held: dict[tuple[int, int], frozenset] = {}

    def keys(side: int, table: pd.DataFrame, at: int) -> frozenset:
        if (side, at) not in held:
            held[side, at] = frozenset(table["keys"].iat[at].tolist())
        return held[side, at]

    out = []
    for start in range(0, len(small), STRIP):
        strip = slice(start, start + STRIP)
        n_s, node_s, root_s, mass_s = (small[c].to_numpy()[strip, None] for c in ("n", "node", "root", "mass"))
        fits = ((n_s < n) | ((n_s == n) & (node_s < node))) & (root_s != root) & (n_s * 100 >= n * PERCENT)
        fits &= np.minimum(mass_s, mass) * (100 + PERCENT) >= (n_s + n) * PERCENT
        if not fits.any():
            continue
        differ = np.zeros(fits.shape, np.uint16)
        for w in range(words):
            differ += np.bitwise_count(bits_small[strip, w, None] ^ bits[:, w])
        x, y = np.nonzero(fits & (differ <= FIRST_DIFFER))
        x += start
        close = np.zeros(len(x), np.int64)
        for w in range(LONG // 64):
            close += np.bitwise_count(bits_small[x, w] ^ bits[y, w])
        for i, j in zip(x[close <= LONG_DIFFER].tolist(), y[close <= LONG_DIFFER].tolist()):
            if min(keys(0, small, i) & keys(1, large, j)) == key:
                out.append((int(small["node"].iat[i]), int(node[j])))
    return out


def _compare_lists(part: pd.DataFrame) -> pd.DataFrame:
    """All lists, or pairs of blocks of lists, of one task."""
    out = []
    for (key, *_), rows in part.groupby(["key", "bucket", "i", "j"], sort=False):
        small, large = rows[rows["small"]], rows[~rows["small"]]
        if len(small) and len(large):
            out += _compare(small, large, key)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _met(able: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet in a list and may be links.

    Lists are split by set size, as a larger set holds at most 4/3 of the smaller one: a set is the smaller of a pair in
    its own size bucket, and the larger one in its own and the one below. A list longer than ``BLOCK`` is split into
    blocks by node, and each pair of blocks is a group of its own; short lists share groups of about that size. So no
    task holds more than a few blocks, however long a list is.
    """
    bucket = F.floor(F.log(4 / 3, F.col("n")) + 1e-9)
    own = F.struct(bucket.alias("bucket"), F.lit(True).alias("small"))
    others = [F.struct((bucket - down).alias("bucket"), F.lit(False).alias("small")) for down in (0, 1)]
    posted = able.select("*", F.explode("keys").alias("key")).withColumn("side", F.explode(F.array(own, *others)))
    posted = posted.select("node", "root", "n", "mass", "keys", "long", "key", "side.*")
    sizes = posted.groupBy("key", "bucket").agg(F.count_if("small").alias("smaller"), F.count_if(~F.col("small")).alias("larger"))
    sizes = stored(sizes.filter("smaller > 0 and larger > 1"), "list-sizes")
    groups = 1 + (sizes.agg(F.sum(F.col("smaller") + F.col("larger"))).first()[0] or 0) // BLOCK
    rows = posted.join(sizes, ["key", "bucket"])
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int") for c in ("smaller", "larger")]
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("small"), blocks[0]).otherwise(blocks[1])).cast("int")
    rows = rows.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.when(F.col("small"), blocks[1]).otherwise(blocks[0]) - 1))
    )
    rows = rows.withColumn("i", F.when(F.col("small"), F.col("mine")).otherwise(F.col("other")))
    rows = rows.withColumn("j", F.when(F.col("small"), F.col("other")).otherwise(F.col("mine")))
    short = (F.col("smaller") <= BLOCK) & (F.col("larger") <= BLOCK)
    group = F.when(short, F.pmod(F.xxhash64("key", "bucket"), F.lit(groups))).otherwise(F.xxhash64("key", "bucket", "i", "j"))
    rows = rows.select(group.alias("group"), "key", "bucket", "i", "j", "small", "node", "root", "n", "mass", "keys", "long")
    return rows.groupBy("group").applyInPandas(_compare_lists, "a long, b long")


def _likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""
    first = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    second = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").filter(_alike(F.col("sa"), F.col("sb"))).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("xa")), sets.select(F.col("node").alias("b"), F.col("s").alias("xb"))
    full = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("xa", "xb"))
    union = F.size("xa") + F.size("xb") - both
    return full.filter(both * 100 >= union * PERCENT).select("a", "b")


def _between(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Postings of keys that more than one component holds, with their component and the hub of the list.

    The hub is the set that shares most with others: the original of a group of edited copies, not one of the copies.
    """
    if roots is None:
        held = postings.withColumn("root", F.col("node"))
    else:
        held = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hub = F.max(F.struct("shared", (-F.col("node")).alias("m"), "root"))
    lists = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub.alias("hub"))
    open_lists = lists.filter("low < high").select("key", F.col("hub.root").alias("to_root"), (-F.col("hub.m")).alias("to_node"))
    return held.join(open_lists, "key")


def _shared_mass(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """For each node how many of its shingles another of the nodes has as well (``mass``): no intersection is larger."""
    shingled = sets.join(nodes, "node", "left_semi").select("node", F.explode("s").alias("h"))
    common = shingled.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h")
    return shingled.join(common, "h").groupBy("node").agg(F.count("*").alias("mass"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when 100 * intersection >= 75 * union of their sets of 5-word shingles; a component is what
    links reach, named by its smallest id. Texts without words are linked with nothing. ``kept`` marks exactly one row of
    every component, one with the smallest id, also among repeated rows. A null id names a component only if it has no
    other. Other columns are ignored; an empty table gives no rows.
    """
    return _judged(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _content(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``id``, ``content`` (a digest of the text), ``n``, ``component_id`` and ``kept``."""
    text = F.coalesce(text_col, F.lit(""))
    sketched, full_set = F.pandas_udf(sketch, SKETCH), F.pandas_udf(shingle_set, "array<long>")
    content = _content(text)
    drawn = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), content.alias("content"), sketched(text).alias("s")
    )
    rows = stored(drawn.select("id", "row", "content", "s.*"), "sketches")
    worded = rows.filter("n > 0")
    classes = stored(
        worded.groupBy("set_digest").agg(F.min_by(F.struct("row", "id", "n", "content", "signature"), "row").alias("r")).select(
            "set_digest", F.col("r.row").alias("node"), "r.id", "r.n", "r.content", "r.signature"
        ),
        "classes",
    )
    postings = stored(posting_prefixes(classes), "postings")
    active = postings.select("node").distinct()
    signatures = stored(classes.join(active, "node", "left_semi").select("node", "id", "content", "signature"), "signatures")
    # full sets only of documents that some other may resemble, of the class's own row: its copies stay where they are
    texts = docs.select(F.col(id_col).alias("of"), text.alias("t"), content.alias("c"))
    own = (F.col("c") == F.col("content")) & F.col("of").eqNullSafe(F.col("id"))
    one_each = texts.join(signatures.select("node", "id", "content"), own).dropDuplicates(["node"])
    sets = stored(one_each.select("node", full_set("t").alias("s")), "sets")

    links, roots = None, None
    for _ in range(STAR_ROUNDS):
        held = _between(postings, roots).filter("root <> to_root")
        met = held.groupBy("root", "to_root").agg(F.count("*").alias("hits"), F.max(F.struct("shared", "node", "to_node")).alias("e"))
        best = met.groupBy("root").agg(F.max_by("e", F.struct("hits", -F.col("to_root"))).alias("e"))
        tried = _likely(best.select(F.col("e.node").alias("a"), F.col("e.to_node").alias("b")), signatures)
        found = _confirm(tried, sets)
        links = stored(found if links is None else found.unionByName(links), "links")
        roots = stored(components(links), "roots")
    # What is left: every pair of different components that shares a prefix posting. No set shares more than its shingles
    # that any other has: edited copies too far from their original, whose own shingles nobody shares, meet nobody here.
    held = stored(_between(postings, roots).select("key", "node", "root", "n"), "open-postings")
    mass = stored(_shared_mass(held.select("node").distinct(), sets), "masses")
    lists = held.groupBy("node", "root", "n").agg(F.collect_set("key").alias("keys"))  # at most a prefix of keys each
    able = lists.join(mass, "node").filter(F.col("mass") * 100 >= F.col("n") * PERCENT).join(sets, "node")
    able = stored(able.select("node", "root", "n", "mass", "keys", F.pandas_udf(long_signature, "array<long>")("s").alias("long")), "able")
    pairs = stored(_met(able), "pairs")
    links = _confirm(pairs, sets).unionByName(links)
    roots = stored(components(links), "roots")

    members = worded.select("id", "row", "content", "n", "set_digest").join(classes.select("set_digest", "node"), "set_digest")
    placed = members.join(roots, "node", "left").select("id", "row", "content", "n", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    names = placed.groupBy("root").agg(F.min(order).alias("f")).select("root", F.col("f.b").alias("component_id"), F.col("f.c").alias("first_row"))
    named = placed.join(names, "root").select("id", "content", "n", "component_id", (F.col("row") == F.col("first_row")).alias("kept"))
    blank = rows.filter("n = 0").select("id", "content", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(blank)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns: one of each, and every one without words.

    A row is found again by its id and text. Repeated rows (same id, same text) leave one if they stand for a group.
    """
    rows = _judged(docs, id_col, text_col).groupBy("id", "content").agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n_rows"))
    changed = stored(rows.filter("n_kept < n_rows").select(F.col("id").alias("_id"), F.col("content").alias("_of"), "n_kept"), "changed")
    marked = docs.withColumn("_content", _content(F.coalesce(text_col, F.lit(""))))
    same = (F.col("_content") == F.col("_of")) & F.col(id_col).eqNullSafe(F.col("_id"))
    out = marked.join(changed, same, "left_anti").select(*docs.columns)
    repeated = changed.filter("n_kept > 0")
    if repeated.isEmpty():
        return out
    return out.unionByName(marked.join(repeated, same).dropDuplicates(["_of", id_col]).select(*docs.columns))


@registry.add(
    "op1_minhash_dedup",
    r"""WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
        FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.v),
    c AS (SELECT v, min(r) AS component_id FROM r GROUP BY v)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
