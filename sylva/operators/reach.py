"""Strong components and reachability on large graphs, by joins and partial aggregates over written tables.

Nodes are numbered by a hash, so that all rounds move longs. Four things keep rounds and rows few:

* A graph of many edges a node is first contracted along the components that a part of its edges, dealt by hash, makes for
  themselves. Then every edge is followed between what is left, which is little, so the components are those of all edges.
* Before components are sought, nodes that nothing enters or leaves go, and nodes of one predecessor and one successor are
  contracted to an edge: in each round those of least rank among such neighbours, so a path shrinks by a constant factor.
* Reachability is counted over the condensed graph: a strong component is one node with a weight, and all its members
  share one row of bits. Components are settled level by level; what one has goes once to the components after it.
* The limit of hops is checked by an upper bound of each node's distance from all that reaches it: along the tree of its
  component, over the lightest edge between components. Only nodes whose bound is above the limit are walked one by one.
* The bound of the largest component, which most pairs go through, is that of the shortest way to its root. The few nodes
  that are furthest from it are walked from, so that the bound of all others is low enough for nearly every member.
* Where that would leave more than a block of nodes to be walked, members of many edges stand in for the root: all that
  reaches the component is near one of them, and what every one of them reaches within the hops that are left is sure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, discard, measured

#: Longs of 64 bits in a row of bits, and levels of the condensed graph that are settled one after the other; what lies
#: deeper is walked like the nodes whose hops are in doubt.
WORDS, LEVELS = 16, 24
#: Nodes of a block of rows of bits.
BLOCK = 64 * WORDS
#: Bits of a rank below the degree's, and the odd constant that draws it anew each turn.
RANK_BITS, DRAW = 52, 0x9E3779B97F4A7
#: Edges a node of the part that a graph is first contracted along, and how many dead nodes for so many edges are worth a round.
PART, WORTH = 5, 50
#: Words of bits for the members of many edges that stand in for the largest component's root.
NEAR = 4


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def numbered_pairs(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids: id, v) and (a, b, n: rows) of every pair of imports; a is null without a source, and so is b. Repeats are one pair.

    A number is RANK_BITS of the id's hash. Should two ids share one, all are numbered anew, by joins.
    """
    hashed = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    number = lambda c: F.when(F.col(c).isNotNull(), hashed(c))
    pairs = cut(imports.groupBy("source", "target").agg(F.count("*").alias("n")).select("source", "target", number("source").alias("a"), number("target").alias("b"), "n"))
    ids = cut(pairs.select(F.col("source").alias("id")).union(pairs.select("target")).dropna().distinct().withColumn("v", hashed("id")))
    if not ids.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        ids = cut(ids.select("id").withColumn("v", F.monotonically_increasing_id()))
        one, two = ids.select(F.col("id").alias("source"), F.col("v").alias("a")), ids.select(F.col("id").alias("target"), F.col("v").alias("b"))
        pairs = cut(pairs.select("source", "target", "n").join(one, "source", "left").join(two, "target", "left"))
    return ids, pairs.select("a", "b", "n")


def numbered_graph(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids: id, v) and edges (a, b) between their numbers; nulls and repeats are left out, loops stay."""
    ids, pairs = numbered_pairs(imports)
    return ids, pairs.select("a", "b").dropna()


def _drawn(v: Column, turn: int) -> Column:
    """Another order of the numbers each turn: exclusive ors and shifts within RANK_BITS, so no two numbers meet."""
    mask = F.lit((1 << RANK_BITS) - 1)
    x = v.bitwiseXOR(F.lit((DRAW * (2 * turn + 1)) & ((1 << RANK_BITS) - 1)))
    for left, right in ((13, 7), (17, 23)):
        x = x.bitwiseXOR(F.shiftleft(x, left)).bitwiseAND(mask)
        x = x.bitwiseXOR(F.shiftrightunsigned(x, right))
    return x


# Contraction


def _contract(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(core edges a, b, w: its length in edges; steps (v, p, s, wp, ws), first ones first; loops (v) that appeared).

    Of each step, v lay between p and s alone and is the edge from p to s from then on. Nodes that cannot lie on a cycle
    leave the graph without a trace.
    """
    live, steps, loops, turn = cut(edges.where("a <> b").select("a", "b", "w")), [], [], 0
    while True:
        none = F.lit(None).cast("long")
        ends = live.select(F.col("a").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o"), none.alias("p"), F.col("b").alias("s"), none.alias("wp"), F.col("w").alias("ws"))
        ends = ends.union(live.select("b", F.lit(1), F.lit(0), "a", none, "w", none))
        degrees = ends.groupBy("v").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), *[F.max(c).alias(c) for c in ("p", "s", "wp", "ws")])
        odd = degrees.where("i = 0 or o = 0 or (i = 1 and o = 1)").withColumn("dead", F.expr("i = 0 or o = 0"))
        odd, n = measured(odd, dead=F.count_if("dead"), thin=F.count_if(~F.col("dead")))
        # A few that are dead do no harm, and paths of them are thin.
        if not n["thin"] and (not n["dead"] or n["dead"] * WORTH <= live.count()):
            break
        at = lambda c: odd.select(F.col("v").alias(c), F.col("dead").alias(f"dead_{c}"), F.lit(True).alias(f"odd_{c}"))  # noqa: B023, E731
        both = live.join(at("a"), "a", "left").join(at("b"), "b", "left").fillna(False, ["dead_a", "dead_b", "odd_a", "odd_b"])
        alive = both.where("not dead_a and not dead_b")
        if n["thin"]:
            rank = lambda c: _drawn(F.col(c), turn)  # noqa: B023, E731
            beaten = alive.where("odd_a and odd_b").select(F.when(rank("a") < rank("b"), F.col("b")).otherwise(F.col("a")).alias("v"))
            step, m = measured(odd.where("not dead").join(beaten, "v", "left_anti").select("v", "p", "s", "wp", "ws"), n=F.count("*"), loops=F.count_if(F.col("p") == F.col("s")))
            gone = lambda c: step.select(F.col("v").alias(c))  # noqa: B023, E731
            rest = alive.select("a", "b", "w").join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti").select("a", "b", "w")
            rest = rest.union(step.where("p <> s").select("p", "s", F.col("wp") + F.col("ws")))
            following = cut(rest.groupBy("a", "b").agg(F.min("w").alias("w")))
            steps += [step] if m["n"] else []
            loops += [step.where("p = s").select(F.col("p").alias("v"))] if m["loops"] else []
        else:
            following = cut(alive.select("a", "b", "w"))
        discard(live, odd)
        live, turn = following, turn + 1
    discard(odd)
    return live, steps, _union(loops).distinct() if loops else live.select(F.col("a").alias("v")).limit(0)


# Strong components


def _coloured(edges: DataFrame, turn: int) -> DataFrame:
    """(v, c, d, root): of all nodes that reach v, itself among them, the rank of the least, and a length of a path from it.

    Nodes of many edges rank first: the tree that grows from such a one is shallow. Ranks tell all nodes apart.
    """
    ends = edges.select(F.col("a").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("b", F.lit(1), F.lit(0)))
    degree = ends.groupBy("v").agg((F.sum("i") + 1).alias("i"), (F.sum("o") + 1).alias("o"))
    bucket = F.lit(1023) - F.least(F.lit(1023), F.floor(8 * F.log2(F.col("i").cast("double") * F.col("o"))))
    start = degree.select("v", F.shiftleft(bucket.cast("long"), RANK_BITS).bitwiseOR(_drawn(F.col("v"), turn)).alias("c"))
    state, n = measured(start.select("v", "c", F.lit(0).cast("long").alias("d"), F.col("c").alias("own"), F.lit(True).alias("fresh")), fresh=F.count_if("fresh"))
    none = F.lit(None).cast("long")

    def moved(state: DataFrame) -> DataFrame:
        arrived = state.where("fresh").select("v", "c", "d").join(edges, F.col("v") == F.col("a")).select(F.col("b").alias("v"), "c", (F.col("d") + F.col("w")).alias("d"), none.alias("own"), none.alias("was"))
        both = state.select("v", "c", "d", "own", F.col("c").alias("was")).union(arrived)
        # Of several rows with the least colour any length will do: each is that of a path.
        best = both.groupBy("v").agg(F.min("c").alias("c"), F.min_by("d", "c").alias("d"), F.max("own").alias("own"), F.max("was").alias("was"))
        return best.withColumn("fresh", F.col("c") < F.col("was")).drop("was")

    while n["fresh"]:
        following, n = measured(moved(moved(state)), fresh=F.count_if("fresh"))
        discard(state)
        state = following
    return state.select("v", "c", "d", (F.col("c") == F.col("own")).alias("root"))


def _reaching(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, c, back) of all that reach the root (v) of their colour c over edges (a, b, w, c), with a length of a path to it."""
    front, n = measured(roots.select("v", "c", F.lit(0).cast("long").alias("back"), F.lit(True).alias("last")), n=F.count("*"))
    found = [front]

    def moved(front: DataFrame, known: list[DataFrame]) -> DataFrame:
        came = front.select("v", "back").join(edges, F.col("v") == F.col("b")).groupBy(F.col("a").alias("v"), "c").agg(F.min(F.col("back") + F.col("w")).alias("back"))
        return came.join(_union([k.select("v") for k in known]), "v", "left_anti")

    while n["n"]:
        one = moved(found[-1].where("last"), found)
        two = moved(one, [*found, one])
        both, n = measured(one.withColumn("last", F.lit(False)).union(two.withColumn("last", F.lit(True))), n=F.count_if("last"))
        found.append(both)
    return _union(found).drop("last")


def _turn(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of edges (a, b, w): (v, comp, fore, back) of the components that the colours of a turn show, all nodes they settle, edges within colours."""
    colours = cut(_coloured(live, turn))
    one, two = colours.select(F.col("v").alias("a"), "c"), colours.select(F.col("v").alias("b"), F.col("c").alias("_c"))
    same = cut(live.join(one, "a").join(two, "b").where("c = _c").select("a", "b", "w", "c"))
    roots = cut(colours.where("root").select("v", "c"))
    members = _reaching(same, roots)
    named = members.join(roots.select("c", F.col("v").alias("comp")), "c").join(colours.select("v", F.col("d").alias("fore")), "v")
    several = named.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
    return cut(named.join(several, "comp").select("v", "comp", "fore", "back")), members.select("v"), same


def _between(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b, w) between what the nodes belong to by groups (v, comp, fore, back), with the least length of root to root."""
    zero = F.lit(0).cast("long")
    end = lambda c: groups.select(F.col("v").alias(c), F.col("comp").alias(f"_{c}"), F.col("fore" if c == "a" else "back").alias(f"d{c}"))
    both = edges.join(end("a"), "a", "left").join(end("b"), "b", "left")
    moved = both.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), (F.coalesce("da", zero) + F.col("w") + F.coalesce("db", zero)).alias("w"))
    return moved.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w"))


def strong_components(edges: DataFrame, nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(v, comp: a member, fore, back: lengths of paths from it and to it) of the nodes on cycles, of edges (a, b); and the
    edges (a, b, w) between components and single nodes, each by a member, with the least length of root to root.

    By contraction, then by colours: every node takes the colour of the least-ranked node that reaches it, and what also
    reaches that node is its component. Edges between colours and to members that were found go, ranks are drawn anew,
    so the turns grow with the logarithm of the components; a turn takes as many rounds as the core is deep. Where there
    are many edges for the number of nodes, a turn on some of them comes first; all edges then count between what it found.
    """
    whole, first = edges.where("a <> b").withColumn("w", F.lit(1).cast("long")), None
    every = edges.count() // (PART * nodes) if nodes else 0
    if every > 1:
        part = cut(whole.where(F.pmod(F.xxhash64("a", "b"), F.lit(every)) == 0))
        first = _turn(part, 0)[0]
        whole = cut(_between(whole, first))
    out = _components(whole, edges.where("a = b").select(F.col("a").alias("v")) if first is None else first.limit(0).select("v"))
    zero = F.lit(0).cast("long")
    if first is not None:
        # What the first turn joined lies in the component of its member, if that has a larger one.
        outer = out.select(F.col("v").alias("comp"), F.col("comp").alias("_x"), F.col("fore").alias("_f"), F.col("back").alias("_b"))
        inner = first.join(outer, "comp", "left").select("v", F.coalesce("_x", "comp").alias("comp"), (F.col("fore") + F.coalesce("_f", zero)).alias("fore"), (F.col("back") + F.coalesce("_b", zero)).alias("back"))
        both = cut(inner.union(out.join(first, "v", "left_anti").select("v", "comp", "fore", "back")))
        loops = edges.where("a = b").select(F.col("a").alias("v")).join(both, "v", "left_anti")
        return cut(both.union(loops.select("v", "v", zero, zero))), _between(whole, out)
    return out, _between(whole, out)


def _components(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """(v, comp, fore, back) of the nodes on cycles of edges (a, b, w) and of the loops (v)."""
    live, steps, more = _contract(edges)
    found, turn = [], 0
    while not live.isEmpty():
        own, gone, same = _turn(live, turn)
        found.append(own)
        rest = same.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti")
        live, turn = cut(_trimmed(rest.select("a", "b", "w"))), turn + 1
    zero = F.lit(0).cast("long")
    # A loop is a component of one, unless its node has others around it; a contracted node is in the component of its ends.
    loops = cut(loops.union(more).distinct())
    own = cut(_union(found)) if found else cut(loops.limit(0).select("v", F.col("v").alias("comp"), zero.alias("fore"), zero.alias("back")))
    alone = loops.join(own, "v", "left_anti")
    if steps:
        alone = alone.join(_union(steps).select("v"), "v", "left_anti")
    out = cut(own.union(alone.select("v", "v", zero, zero)))
    for step in reversed(steps):
        end = lambda c: out.select(F.col("v").alias(c), F.col("comp").alias(f"comp_{c}"), F.col("fore").alias(f"fore_{c}"), F.col("back").alias(f"back_{c}"))  # noqa: B023, E731
        inner = step.join(end("p"), "p").join(end("s"), "s").where("comp_p = comp_s").select("v", F.col("comp_p").alias("comp"), (F.col("fore_p") + F.col("wp")).alias("fore"), (F.col("back_s") + F.col("ws")).alias("back"))
        inner = cut(inner)
        single = loops.join(step.select("v"), "v", "left_semi").join(inner, "v", "left_anti").select("v", F.col("v").alias("comp"), zero.alias("fore"), zero.alias("back"))
        following = cut(out.union(inner).union(single))
        discard(out, inner)
        out = following
    return out


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges (a, b, w) without those at nodes that nothing enters or leaves, as far as two rounds see."""
    for _ in range(2):
        edges = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b", "w")
        edges = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b", "w")
    return edges


def cyclic_components(imports: DataFrame) -> DataFrame:
    """(id, component: its smallest member) of the nodes of imports (source, target) that lie on cycles."""
    ids, edges = numbered_graph(imports)
    named = cut(strong_components(edges, ids.count())[0].join(ids, "v").select("id", "comp"))
    return named.join(named.groupBy("comp").agg(F.min("id").alias("component")), "comp").select("id", "component")


# Reachability


def _bits(nodes: DataFrame, name: str, count: int | None = None, words: int = WORDS) -> DataFrame:
    """(name, block, word, bit) of nodes (name): a place of its own for each, 64 * words of them in a block.

    Blocks are dealt by hash; what overflows one goes to a further block of that hash, so none is too large.
    """
    size, count = 64 * words, nodes.count() if count is None else count
    deal = max(1, -(-count * 10 // (size * 9))) if count > size else 1
    own = nodes.withColumn("_b", F.pmod(F.xxhash64(name), F.lit(deal)))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(name)) - 1
    own = own.withColumn("_at", at).withColumn("block", F.col("_b") + F.floor(F.col("_at") / size) * deal)
    place = F.col("_at") % size
    return own.select(name, "block", F.floor(place / 64).cast("int").alias("word"), (place % 64).cast("int").alias("bit"))


_NEW, _OLD = [f"w{i}" for i in range(WORDS)], [f"s{i}" for i in range(WORDS)]


def _one(i: int) -> Column:
    return F.when(F.col("word") == i, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))


def _merged(df: DataFrame, *keys: str, columns: list[str] = _NEW) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.bit_or(c).alias(c) for c in columns])


def _held(columns: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(w) != 0 for w in columns])


def _settled(dag: DataFrame, size: DataFrame, own: DataFrame, levels: int) -> DataFrame:
    """(x, n) of the condensed nodes own (x, level): the weights of all that reach them over dag (x, y)."""
    inner = cut(dag.join(own.select(F.col("x").alias("y"), "level"), "y").select("x", "y", "level"))
    places = cut(_bits(inner.select("x").distinct(), "x").join(size, "x"))
    sent: list[DataFrame] = []
    for i in range(levels - 1):
        out = inner.join(own.where(F.col("level") == i).select("x"), "x", "left_semi")
        moved = out.join(places, "x").select(F.col("y").alias("x"), "block", *[_one(k).alias(w) for k, w in enumerate(_NEW)], "level")
        if sent:
            rows = _merged(_union(sent).where(F.col("level") == i), "x", "block")
            moved = moved.union(out.join(rows, "x").select(F.col("y").alias("x"), "block", *_NEW, "level"))
        sent.append(cut(_merged(moved, "x", "block", "level")))
    if not sent:
        return size.limit(0).select("x", F.lit(0).cast("long").alias("n"))
    # What bits weigh beyond one is added by the binary places of those weights: a mask of a block for each place.
    bits = cut(_merged(_union(sent), "x", "block"))
    plain = bits.select("x", sum((F.bit_count(w) for w in _NEW), F.lit(0)).cast("long").alias("n"))
    power = F.expr("explode(filter(sequence(0, 62), j -> (shiftright(size - 1, j) & 1L) = 1))")
    masks = [f"m{i}" for i in range(WORDS)]
    heavy = cut(places.where("size > 1").withColumn("power", power).groupBy("block", "power").agg(*[F.bit_or(_one(i)).alias(m) for i, m in enumerate(masks)]))
    set_ = sum((F.bit_count(F.col(w).bitwiseAND(F.col(m))) for w, m in zip(_NEW, masks, strict=True)), F.lit(0)).cast("long")
    extra = bits.join(heavy, "block").select("x", set_.alias("set"), "power").select("x", F.expr("shiftleft(set, power)").alias("n"))
    return plain.union(extra).groupBy("x").agg(F.sum("n").alias("n"))


def _spread(edges: DataFrame, asked: DataFrame, hops: int | None) -> tuple[DataFrame, DataFrame]:
    """(places of the asked nodes v; rows x, block, words: which of them x reaches within hops over edges (a, b)).

    A bit stands for an asked node; a row holds which of a block of them a node reaches. Each round moves the new bits
    against the edges, merges them by bit_or (partly before the shuffle) and keeps those not yet seen. Where few nodes are
    asked, rows have but the words for them.
    """
    many = asked.count()
    wide = min(WORDS, max(1, -(-many // 64)))
    new, old = _NEW[:wide], _OLD[:wide]
    places = cut(_bits(asked, "v", many, wide))
    zero = F.lit(0).cast("long")
    first = edges.join(places, F.col("b") == F.col("v")).select(F.col("a").alias("x"), "block", *[_one(i).alias(w) for i, w in enumerate(new)])
    state, n = measured(_merged(first, "x", "block", columns=new).select("x", "block", *new, *[zero.alias(s) for s in old]), fresh=F.count("*"))
    hop = 1
    while n["fresh"] and (hops is None or hop < hops):
        front = state.where(_held(new))
        moved = front.join(edges, F.col("x") == F.col("b")).select(F.col("a").alias("x"), "block", *new, *[zero.alias(s) for s in old])
        seen = state.select("x", "block", *[zero.alias(w) for w in new], *[F.col(s).bitwiseOR(F.col(w)).alias(s) for w, s in zip(new, old, strict=True)])
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.col(s))).alias(w) for w, s in zip(new, old, strict=True)]
        following, n = measured(_merged(moved.union(seen), "x", "block", columns=[*new, *old]).select("x", "block", *fresh, *old), fresh=F.count_if(_held(new)))
        discard(state)
        state, hop = following, hop + 1
    words = [F.col(w).bitwiseOR(F.col(s)).alias(w) for w, s in zip(new, old, strict=True)]
    return places, state.select("x", "block", *words)


def _words(rows: DataFrame) -> list[str]:
    return [w for w in _NEW if w in rows.columns]


def _walked(edges: DataFrame, asked: DataFrame, hops: int | None) -> DataFrame:
    """(v, n): how many nodes reach each of the asked nodes v within hops over edges (a, b), node by node."""
    places, rows = _spread(edges, asked, hops)
    # How many rows have each bit: one row of a thousand sums for each block, then one for each asked node.
    each = rows.select("block", F.posexplode(F.array(*_words(rows))).alias("word", "bits")).where("bits <> 0")
    lanes = [F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{k}") for k in range(64)]
    sums = each.groupBy("block", "word").agg(F.array(*lanes).alias("sums"))
    return places.join(sums, ["block", "word"]).select("v", F.get("sums", F.col("bit")).alias("n")).where("n > 0")


def _arrived(edges: DataFrame, asked: DataFrame, hops: int | None) -> DataFrame:
    """(v, n): how many of the asked nodes reach each node v within hops over edges (a, b), if any."""
    _, rows = _spread(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), asked, hops)
    return rows.groupBy(F.col("x").alias("v")).agg(F.sum(sum((F.bit_count(w) for w in _words(rows)), F.lit(0))).cast("long").alias("n"))


def _toward(dag: DataFrame, hub: int) -> DataFrame | None:
    """(x, toward) of all condensed nodes that reach hub: the least length over dag (x, y, w); None if they lie too deep."""
    start = dag.sparkSession.createDataFrame([(hub, 0, True)], "x long, toward long, fresh boolean")
    state, n = measured(start, fresh=F.count_if("fresh"))
    for _ in range(LEVELS):
        if not n["fresh"]:
            return state.select("x", "toward")
        came = state.where("fresh").select(F.col("x").alias("y"), "toward").join(dag, "y").select("x", (F.col("toward") + F.col("w")).alias("toward"), F.lit(None).cast("long").alias("was"))
        best = came.union(state.select("x", "toward", F.col("toward").alias("was"))).groupBy("x").agg(F.min("toward").alias("toward"), F.max("was").alias("was"))
        following, n = measured(best.select("x", "toward", (F.col("was").isNull() | (F.col("toward") < F.col("was"))).alias("fresh")), fresh=F.count_if("fresh"))
        discard(state)
        state = following
    return None if n["fresh"] else state.select("x", "toward")


def _sure(edges: DataFrame, members: DataFrame, hops: int) -> DataFrame | None:
    """(v) of the members of a component that all which reaches it reaches within hops, as far as some members of many edges show.

    Whatever reaches the component is at most so many hops from the nearest of these; what each of them reaches within the
    rest of the hops is sure. None if nothing is.
    """
    degree = edges.join(members.select(F.col("v").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("v")).agg(F.count("*").alias("n"))
    some, many = measured(degree.orderBy(F.desc("n"), "v").limit(64 * NEAR).select("v", F.lit(0).alias("hop")), n=F.count("*"))
    found, furthest = [some], 0

    def moved(front: DataFrame, known: list[DataFrame], hop: int) -> DataFrame:
        came = front.select("v").join(edges, F.col("v") == F.col("b")).select(F.col("a").alias("v")).distinct()
        return came.join(_union([k.select("v") for k in known]), "v", "left_anti").withColumn("hop", F.lit(hop))

    while furthest < hops:
        one = moved(found[-1].where(F.col("hop") == furthest), found, furthest + 1)
        two = moved(one, [*found, one], furthest + 2)
        both, n = measured(one.union(two), one=F.count_if(F.col("hop") == furthest + 1), two=F.count_if(F.col("hop") == furthest + 2))
        found.append(both)
        furthest += 2 if n["two"] else 1 if n["one"] else 0
        if not n["two"]:
            break
    discard(*found[1:])
    if furthest >= hops:
        return None
    _, rows = _spread(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), some.select("v"), hops - furthest)
    reached = rows.groupBy(F.col("x").alias("v")).agg(F.sum(sum((F.bit_count(w) for w in _words(rows)), F.lit(0))).alias("n"))
    return cut(reached.where(F.col("n") == many["n"]).join(members, "v", "left_semi").select("v"))


def _hub(nodes: DataFrame, size: DataFrame, dag: DataFrame, edges: DataFrame, hops: int | None) -> tuple[int, int, DataFrame, int, DataFrame | None] | None:
    """(the largest component, a bound of how far its root is from what reaches it but for far, far: v, and their number,
    v of members that are sure without that bound).

    far are those further away than the bound, which is the one that leaves least to be walked: far, and members that the
    bound and their own distance put in doubt. None without such a component, or if what reaches it lies too deep.
    """
    first = size.where("size > 1").orderBy(F.desc("size"), "x").first() if hops is not None else None
    toward = _toward(dag, first["x"]) if first else None
    if toward is None:
        return None
    away = cut(nodes.join(toward, "x").select("v", (F.col("back") + F.col("toward")).alias("away")))
    tally = lambda df, c: {r[0]: r[1] for r in df.groupBy(F.least(F.col(c), F.lit(hops + 1)).cast("int")).agg(F.count("*")).collect()}  # noqa: E731  # at most hops + 2 rows
    members, sure = nodes.where(F.col("x") == first["x"]), None
    before, after = tally(away, "away"), tally(members, "fore")
    more = lambda counts, t: sum(n for d, n in counts.items() if d > t)
    cost = lambda t: -(-more(before, t) // BLOCK) - (-more(after, hops - t) // BLOCK)
    least = min(range(hops, -1, -1), key=cost)
    if cost(least) > 1 and (sure := _sure(edges, members.select("v"), hops)) is not None:
        after = tally(members.join(sure, "v", "left_anti"), "fore")
        least = min(range(hops, -1, -1), key=cost)
    if cost(least) >= -(-first["size"] // BLOCK):
        return None
    bound = max(d for d in before if d <= least)
    return first["x"], bound, away.where(F.col("away") > bound).select("v"), more(before, bound), sure


def reach_counts(imports: DataFrame, hops: int | None = 51) -> DataFrame:
    """counted_reach of imports (source, target)."""
    return counted_reach(*numbered_graph(imports), hops)


def counted_reach(ids: DataFrame, edges: DataFrame, hops: int | None = 51) -> DataFrame:
    """(id, transitive_impact): how many nodes reach each node within hops, itself if it lies on a cycle.

    No pair of nodes is ever a row, and neither the graph nor a node's ancestors are gathered: rows of bits are condensed
    nodes times blocks of 1,024 of them, and nodes times blocks of the nodes in doubt. Nodes that nothing reaches do not
    come back. Nulls, repeats and an empty table are no matter.
    """
    comps, between = strong_components(edges, ids.count())
    zero = F.lit(0).cast("long")
    # Of every node: the condensed one that it belongs to, and its distances from and to that one's root.
    nodes = cut(ids.select("v").join(comps, "v", "left").select("v", F.coalesce("comp", "v").alias("x"), F.coalesce("fore", zero).alias("fore"), F.coalesce("back", zero).alias("back"), F.col("comp").isNotNull().alias("cyclic")))
    dag = cut(between.select(F.col("a").alias("x"), F.col("b").alias("y"), "w"))
    round_ = F.min(F.when(F.col("fore") > 0, F.col("fore") + F.col("back")))
    size = cut(nodes.groupBy("x").agg(F.count("*").alias("size"), F.max("back").alias("far"), round_.alias("round"), F.max("cyclic").alias("cyclic")))
    hub, bound, far_off, many, shown = _hub(nodes, size, dag, edges, hops) or (None, None, None, 0, None)
    is_hub = F.col("x") == hub if hub is not None else F.lit(False)
    # Level by level: a condensed node is ready when all before it are settled; far: how far what reaches its root is at most.
    left = cut(size.join(dag.groupBy(F.col("y").alias("x")).agg(F.count("*").alias("wait")), "x", "left").select("x", F.when(is_hub, bound).otherwise(F.col("far")).cast("long").alias("far"), F.coalesce("wait", F.lit(0)).alias("wait"), F.lit(None).cast("int").alias("level"), is_hub.alias("below")))
    within = F.lit(True) if hops is None else F.col("far") <= hops
    for i in range(LEVELS):
        ready = (F.col("wait") == 0) & F.col("level").isNull() & within
        came = dag.join(left.where(ready).select("x", "far", "below"), "x").groupBy(F.col("y").alias("x")).agg(F.count("*").alias("got"), F.max(F.col("far") + F.col("w")).alias("further"), F.max("below").alias("after"))
        rest = left.withColumn("level", F.when(ready, i).otherwise(F.col("level"))).join(came, "x", "left")
        rest = rest.select("x", F.when(is_hub, F.col("far")).otherwise(F.greatest("far", F.coalesce("further", zero))).alias("far"), (F.col("wait") - F.coalesce("got", F.lit(0))).alias("wait"), "level", (F.col("below") | F.coalesce("after", F.lit(False))).alias("below"))
        following, n = measured(rest, n=F.count_if(F.col("level") == i))
        discard(left)
        left = following
        if not n["n"]:
            break
    settled = left.where("level is not null")
    counted = _settled(dag, size, settled.select("x", "level"), i + 1)
    far = settled.select("x", F.col("far").alias("reach"), "below")
    known = cut(nodes.join(far, "x", "left").join(size.select("x", "size", "round"), "x"))
    # A root returns to itself by way of a member.
    bound = F.when(F.col("cyclic") & (F.col("fore") == 0), F.greatest("reach", F.coalesce("round", zero))).otherwise(F.col("reach") + F.col("fore"))
    sure = F.col("reach").isNotNull() & (F.lit(hops is None) | (bound <= (hops or 0)))
    if shown is not None:
        known = cut(known.join(shown.withColumn("shown", F.lit(True)), "v", "left"))
        sure = sure | (F.col("reach").isNotNull() & F.col("shown").isNotNull())
    own = known.where(sure).join(counted, "x", "left")
    out = own.select("v", (F.coalesce("n", zero) + F.when(F.col("cyclic"), F.col("size")).otherwise(0)).alias("n"), "below")
    if many:
        # All that are far off reach what is below the hub; of these only those within the hops count.
        near = _arrived(edges, far_off, hops).select("v", F.col("n").alias("within"))
        out = out.join(near, "v", "left").select("v", F.when(F.col("below"), F.col("n") - many + F.coalesce("within", zero)).otherwise(F.col("n")).alias("n"), "below")
    out = out.drop("below")
    asked = cut(known.where(~sure).select("v"))
    if not asked.isEmpty():
        out = out.union(_walked(edges, asked, hops))
    return out.where("n > 0").join(ids, "v").select("id", F.col("n").cast("long").alias("transitive_impact"))
