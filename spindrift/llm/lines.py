"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised (lower case, numbers to 0, everything else to single spaces)
and get a 64-bit SimHash of their distinct words; a line of fewer than four words
has too few bits of its own for that and gets the hash of the whole line. Equal
normalised lines are one node; nodes are linked if their fingerprints differ in at
most three bits and their edit similarity is 0.8 or more. Candidates meet on
pigeonhole blocks: with five blocks and three differing bits two blocks agree, so a
fingerprint is filed under its ten pairs of blocks, and a key is 25 or 26 bits wide.
Of each connected group the first occurrence (least document, then least line) stays.

Texts are normalised as a whole, before they are split. Only keys, fingerprints and
places of lines are shuffled to find groups; texts move once for the candidates'
edit distances and once to take lines out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, never_broadcast, unused

DISTANCE = 3
SIMILARITY = 0.8
LEAST_WORDS = 4  # distinct words of a line that has a SimHash
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and width
_LANES = 0x0101010101010101
_CHUNK = 126  # words whose counts fit the eight-bit lanes of a signed long, and seven planes of bits


def normalised(text: Column) -> Column:
    """``text`` in lower case, numbers as 0, everything but letters, zeros and line feeds as single spaces."""
    zeros = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    single = F.regexp_replace(zeros, r"[^a-z0 \n\p{L}]+", " ")
    for _ in range(2):  # most runs of spaces are short, and plain replacing is the quicker way
        single = F.replace(single, F.lit("  "), F.lit(" "))
    return F.regexp_replace(single, "  +", " ")


def _lanes(words: str) -> str:
    """Counts of set bits of at most ``_CHUNK`` hashes: eight longs, the i-th with bits i, i + 8, ... in its lanes of eight bits."""
    return f"aggregate({words}, array_repeat(0L, 8), (a, h) -> transform(a, (v, i) -> v + (shiftrightunsigned(h, i) & {_LANES}L)))"


def _long_majority(chunks: str, n: str) -> str:
    """The long whose bit k is set if that bit's count over all ``chunks`` (of ``_lanes``) is over half of ``n``."""
    total = f"aggregate({chunks}, 0L, (t, x) -> t + (shiftrightunsigned(x[k % 8], k - k % 8) & 255L))"
    return f"aggregate(sequence(0, 63), 0L, (bits, k) -> bits | if(2 * {total} > {n}, shiftleft(1L, k), 0L))"


def _planes(hashed: DataFrame, between: dict[int, tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Counts of set bits of the first ``_CHUNK`` hashes of ``_h``, for all 64 bits at once, as planes of binary digits.

    Full adders join three longs of one weight to a sum and a carry; each layer of
    them is a projection. ``between`` names further columns and the layers that make
    them: lambdas there part the layers into methods short enough to be compiled.
    """
    kept = [f"`{c}`" for c in hashed.columns]
    weights, layer = [[f"coalesce(get(_h, {k}), 0L)" for k in range(_CHUNK)]], 0
    while any(len(w) > 1 for w in weights):
        placed: list[tuple[int, str]] = []
        for k, cols in enumerate(weights):
            whole = len(cols) - len(cols) % 3 if layer else 0
            for a, b, c in zip(cols[:whole:3], cols[1:whole:3], cols[2:whole:3]):
                placed += [(k, f"{a} ^ {b} ^ {c}"), (k + 1, f"(({a} & {b}) | ({c} & ({a} ^ {b})))")]
            rest = cols[whole:]
            if layer and len(cols) == 2:
                placed += [(k, f"{rest[0]} ^ {rest[1]}"), (k + 1, f"{rest[0]} & {rest[1]}")]
            else:
                placed += [(k, c) for c in rest]
        more = [f"{expr} AS {name}" for name, expr in [between[layer]]] if layer in between else []
        hashed = hashed.selectExpr(*kept, *more, *[f"{e} AS _p{layer}_{k}" for k, (_, e) in enumerate(placed)])
        kept += [between[layer][0]] if more else []
        weights = [w for at in range(len(weights) + 1) if (w := [f"_p{layer}_{k}" for k, (x, _) in enumerate(placed) if x == at])]
        layer += 1
    return hashed, [w[0] for w in weights]


def _over_half(planes: list[str], n: str) -> str:
    """The long whose bits are set where the number in ``planes`` is over half of ``n``: the carry of adding what lacks to 2^7."""
    carry = "0L"
    for k, p in enumerate(planes):
        own = f"(-(shiftright({1 << len(planes)}L - shiftright({n}, 1) - 1, {k}) & 1L))"
        carry = f"(({p} & {own}) | ({carry} & ({p} | {own})))"
    return carry


def with_simhash(lines: DataFrame, norm: str = "norm") -> DataFrame:
    """``lines`` with ``fp``: the SimHash of the distinct words of column ``norm``, or the hash of all of it below ``LEAST_WORDS``."""
    columns = [f"`{c}`" for c in lines.columns]
    hashed = lines.selectExpr("*", f"array_distinct(transform(split(`{norm}`, ' '), w -> xxhash64(w))) AS _h").selectExpr("*", "CAST(size(_h) AS BIGINT) AS _n")
    chunks = f"if(_n > {_CHUNK}, transform(sequence(1, CAST(_n AS INT), {_CHUNK}), k -> {_lanes(f'slice(_h, k, {_CHUNK})')}), null)"
    long_fp = f"if(_n > {_CHUNK}, {_long_majority('_c', '_n')}, 0L)"
    added, planes = _planes(hashed, {2: ("_c", chunks), 4: ("_f", long_fp)})
    fp = f"CASE WHEN _n < {LEAST_WORDS} THEN xxhash64(`{norm}`) WHEN _n > {_CHUNK} THEN _f ELSE {_over_half(planes, '_n')} END"
    return added.selectExpr(*columns, f"{fp} AS fp")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, key (128 bits of the normalised line) and norm of every line that holds a letter or digit."""
    whole = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    one = whole.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return one.select("doc_id", "pos", F.trim("line").alias("norm")).where("norm <> ''").withColumn("key", F.unhex(F.md5(F.col("norm").cast("binary"))))


def _filed(fps: DataFrame) -> DataFrame:
    """(slot, fp): each fingerprint under its pairs of blocks."""

    def block(k: int) -> Column:
        first, width = _BLOCKS[k]
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    slots = [
        F.lit(t << 26).cast("long").bitwiseOR(F.shiftleft(block(a), 13)).bitwiseOR(block(b))
        for t, (a, b) in enumerate(combinations(range(len(_BLOCKS)), 2))
    ]
    return fps.select("fp", F.explode(F.array(*slots)).alias("slot"))


def _edits_by_words(a: str, b: str) -> str:
    """Edits that make the words ``a`` into ``b``, and so no less than the edit distance of the lines.

    Words are taken one after the other; where they differ, one of them is left out if that brings equal words together, else one takes the other's place.
    """
    b_word, b_next = f"get({b}, s.j)", f"get({b}, s.j + 1)"
    cases = [
        (f"x.w <=> {b_word}", "s.j + 1", "s.n"),
        (f"x.w <=> {b_next}", "s.j + 2", f"s.n + char_length({b_word}) + 1"),
        (f"x.after = {b_word} OR s.j >= size({b})", "s.j", "s.n + char_length(x.w) + 1"),
        ("true", "s.j + 1", f"s.n + greatest(char_length(x.w), char_length({b_word}))"),
    ]
    step = " ".join(f"WHEN {when} THEN named_struct('j', {j}, 'n', {n})" for when, j, n in cases)
    rest = f"aggregate(slice({b}, s.j + 1, size({b})), 0, (n, w) -> n + char_length(w) + 1)"
    words = f"zip_with({a}, slice({a}, 2, size({a})), (w, after) -> named_struct('w', w, 'after', after))"
    return f"aggregate({words}, named_struct('j', 0, 'n', 0), (s, x) -> CASE {step} END, s -> s.n + {rest})"


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose ``norm`` and ``norm2`` have that edit similarity.

    Words that both begin or end with do not change the distance and are left out,
    one word at least being kept of each. Most pairs need no distance, as what is left
    is short or few of its words differ; for others smaller bounds are tried before the
    full one, as the cost of a distance grows with its bound.
    """
    most = F.floor(F.lit(1 - similarity + 1e-9) * F.greatest(F.char_length("norm"), F.char_length("norm2"))).cast("int")

    def known(df: DataFrame, **columns: Column) -> DataFrame:
        """``df`` with columns that are worked out once a row: a filter above does not work them out again wherever it names them."""
        return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))

    def common(a: Column, b: Column, limit: Column) -> Column:
        first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
        return F.least(F.when(first == 0, limit).otherwise(first - 1), limit)

    inner = lambda w: F.slice(w, F.col("_p") + 1, F.size(w) - F.col("_p") - F.col("_s"))
    p = known(pairs, _most=most).where("abs(char_length(norm) - char_length(norm2)) <= _most")
    p = known(p, _w=F.split("norm", " "), _w2=F.split("norm2", " "))
    p = known(p, _p=common(F.col("_w"), F.col("_w2"), F.least(F.size("_w"), F.size("_w2")) - 1))
    p = known(p, _s=common(F.reverse("_w"), F.reverse("_w2"), F.least(F.size("_w"), F.size("_w2")) - 1 - F.col("_p")))
    p = known(p, _a=inner(F.col("_w")), _b=inner(F.col("_w2")))
    p = known(p, _left=F.array_join("_a", " "), _left2=F.array_join("_b", " "))
    few = f"greatest(char_length(_left), char_length(_left2)) <= _most OR {_edits_by_words('_a', '_b')} <= _most"
    steps = " ".join(f"WHEN levenshtein(_left, _left2, least(_most, {k})) >= 0 THEN true WHEN _most <= {k} THEN false" for k in (16, 64, 256, 1024))
    return p.where(f"CASE WHEN {few} THEN true {steps} ELSE levenshtein(_left, _left2, _most) >= 0 END")


def _first_meeting() -> Column:
    """Whether a slot is the first that ``fp`` and ``fp2`` share: blocks before its second one differ, but for its first."""
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    apart = [F.shiftrightunsigned(differ, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")) != 0 for first, width in _BLOCKS]
    out = F.lit(True)
    for t, (a, b) in enumerate(combinations(range(len(_BLOCKS)), 2)):
        for k in set(range(b)) - {a}:
            out = out & ((F.shiftright("slot", 26) != t) | apart[k])
    return out


def _node() -> Column:
    """A distinct line, ordered by its first place."""
    return F.struct("doc_id", "pos", "key")


def fuzzy_groups(scratch: Scratch, docs: DataFrame, distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the distinct lines that have a fuzzy link; ``component`` is the least node, the first occurrence.

    Pairs are only made where they can change a group. First each line meets the least
    line of its fingerprint, and these those of the least fingerprint nearby. All other
    pairs whose lengths allow it are made and verified if their ends are then still in
    different groups, so that no link is lost and a group of very many variants makes
    no pairs of them all.
    """
    hubs = scratch.stage(distinct.groupBy("fp").agg(F.min(_node()).alias("hub"), F.count("*").alias("n")), "hubs")
    filed = _filed(hubs)
    other = _filed(hubs).select(F.col("fp").alias("fp2"), F.col("slot").alias("slot2"))
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE) & _first_meeting()
    met = scratch.stage(filed.join(never_broadcast(other), (F.col("slot") == F.col("slot2")) & near).select("fp", "fp2"), "near")

    near_fps = met.select("fp").unionByName(met.select(F.col("fp2").alias("fp"))).unionByName(hubs.where("n > 1").select("fp")).distinct()
    members = scratch.stage(distinct.join(never_broadcast(near_fps), "fp").select("fp", "n_chars", _node().alias("node")), "members")
    if members.isEmpty():
        return members.select("node", F.col("node").alias("component"))
    by_doc = members.groupBy("node.doc_id").agg(F.collect_list("node").alias("want"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(by_doc, "doc_id")
    texts = texts.withColumn("lines", F.split("text", "\n", -1)).select("lines", F.explode("want").alias("node"))
    texts = texts.select("node", F.trim(normalised(F.get("lines", F.col("node.pos")))).alias("norm")).where("norm is not null")
    # Rows repeated under one id may hold other texts there; the key tells.
    texts = scratch.stage(texts.where(F.unhex(F.md5(F.col("norm").cast("binary"))) == F.col("node.key")).dropDuplicates(["node"]), "candidates")

    def verified(some: DataFrame, ends: tuple[str, str]) -> DataFrame:
        both = some.join(texts, "node").join(texts.select(F.col("node").alias("node2"), F.col("norm").alias("norm2")), "node2")
        return scratch.stage(_alike(both, similarity).select(*ends), "links")

    hub = hubs.select("fp", "hub")
    own = members.select(F.col("node").alias("node2"), "fp").join(hubs.where("n > 1").select("fp", F.col("hub").alias("node")), "fp").where("node < node2").select("node", "node2")
    least = met.groupBy("fp2").agg(F.min("fp").alias("fp"))
    star = least.join(hub.withColumnRenamed("hub", "node"), "fp").join(hub.select(F.col("fp").alias("fp2"), F.col("hub").alias("node2")), "fp2").select("node", "node2")
    first = verified(own.unionByName(star), ("node", "node2"))
    joined = scratch.stage(connected_components(scratch, first), "joined")
    placed = scratch.stage(members.join(joined, "node", "left").select("node", "fp", "n_chars", F.coalesce("component", "node").alias("c")), "placed")

    second = placed.select(F.col("node").alias("node2"), F.col("fp").alias("fp2"), F.col("n_chars").alias("n_chars2"), F.col("c").alias("c2"))
    edits = F.floor(F.lit(1 - similarity + 1e-9) * F.greatest("n_chars", "n_chars2"))
    open_pair = (F.col("c") != F.col("c2")) & (F.abs(F.col("n_chars") - F.col("n_chars2")) <= edits)
    same = placed.join(second, (F.col("fp") == F.col("fp2")) & (F.col("node") < F.col("node2")) & open_pair)
    sides = placed.groupBy("fp").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    apart = met.join(sides, "fp").join(sides.select(F.col("fp").alias("fp2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "fp2")
    apart = scratch.stage(apart.where("NOT (lo = hi AND lo2 = hi2 AND lo = lo2)").select("fp", "fp2"), "apart")
    across = apart.join(placed.select("fp", "node", "n_chars", "c"), "fp").join(second, "fp2").where(open_pair)
    pair = ("node", "node2", "c", "c2")
    more = connected_components(scratch, verified(same.select(*pair).unionByName(across.select(*pair)), ("c", "c2")))
    more = scratch.stage(more.select(F.col("node").alias("c"), F.col("component").alias("whole")), "whole")
    return placed.join(more, "c", "left").select("node", F.coalesce("whole", "c").alias("component"))


def removals(scratch: Scratch, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, gone): the line numbers that each document loses."""
    lines = with_simhash(lines_of(docs)).select("doc_id", "pos", "key", "fp", F.char_length("norm").alias("n_chars"))
    lines = scratch.stage(lines, "lines")
    place = F.struct("doc_id", "pos")
    distinct = lines.groupBy("key").agg(F.min("fp").alias("fp"), F.min("n_chars").alias("n_chars"), F.min(place).alias("first"), F.count("*").alias("n"))
    distinct = scratch.stage(distinct.select("key", "fp", "n_chars", "n", "first.doc_id", "first.pos"), "distinct")
    groups = scratch.stage(fuzzy_groups(scratch, docs, distinct, similarity), "groups")
    kept = F.coalesce("component", _node())
    decided = distinct.withColumn("node", _node()).join(groups, "node", "left").where("n > 1 or component is not null")
    decided = scratch.stage(decided.select("key", F.struct(kept["doc_id"].alias("doc_id"), kept["pos"].alias("pos")).alias("kept")), "decided")
    gone = lines.join(decided, "key").where(place != F.col("kept"))
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; adds ``n_lines`` and ``n_removed``.

    ``docs`` needs ``doc_id`` and ``text``; all columns are kept (columns named
    ``n_lines`` or ``n_removed`` are replaced). Lines end at line feeds; lines
    without a letter or digit always stay. A null text stays null and has no lines,
    an empty text is one line. Rows without an id stay as they are and remove
    nothing elsewhere. Rows repeated under one id lose the same lines. A document
    that loses all its lines keeps its row with an empty text. An empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    id_, gone_, lines_, text_ = unused(docs, "_id", "_gone", "_lines", "_text")
    gone = removals(scratch, docs, similarity).select(F.col("doc_id").alias(id_), F.col("gone").alias(gone_))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col(id_), "left").withColumn(lines_, F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone_))
    text = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(lines_, k)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_)).cast("long")
    n_removed = F.coalesce(F.size(gone_).cast("long"), F.lit(0).cast("long"))
    out = joined.withColumns({"n_lines": n_lines, "n_removed": F.when(F.col(gone_).isNull(), F.lit(0).cast("long")).otherwise(n_removed), text_: text})
    return out.withColumn("text", F.col(text_)).select(*docs.columns, "n_lines", "n_removed")
