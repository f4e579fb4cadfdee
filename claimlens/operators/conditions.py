"""Conditions of rules as a table of their nodes, and what follows from it: constraints, canonical digests.

    rule, node, ancestors (nodes from the root down), kind, op, field, low, high, text

Kinds are and, or, not, exists, forall and the leaves of ``predicates``. A leaf that compares has
``op`` and its value in ``low`` or ``text``; between has both bounds. A quantifier's collection is
its ``field``. Fields of an item are named by the collection and the quantifier's number, so what
an author calls a loop variable makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "rule string, node int, ancestors array<int>, kind string, op string, field string, low double, high double, text string"
_INNER = ("and", "or", "not", "exists", "forall")


def rows_of(rule: str, tree: tuple) -> Iterator[tuple]:
    """The nodes of one predicate's tree, in preorder."""
    count = 0

    def walk(node: tuple, above: list[int]) -> Iterator[tuple]:
        nonlocal count
        own, kind = count, node[0]
        count += 1
        leaf = dict(zip(("op", "field", "low", "high", "text"), node[1:], strict=False)) if kind not in _INNER else {"field": node[1] if kind in ("exists", "forall") else None}
        yield (rule, own, above, kind, leaf.get("op"), leaf.get("field"), leaf.get("low"), leaf.get("high"), leaf.get("text"))
        for child in (node[1:] if kind in ("and", "or", "not") else node[2:] if kind in ("exists", "forall") else ()):
            yield from walk(child, [*above, own])

    return walk(tree, [])


def table(spark: SparkSession, trees: dict[str, tuple]) -> DataFrame:
    """The nodes of a rule library: rule name to predicate tree."""
    return spark.createDataFrame([r for name, tree in trees.items() for r in rows_of(name, tree)], SCHEMA)


def constraints(conditions: DataFrame) -> DataFrame:
    """rule, scope, field, low, low_open, high, high_open, text: what every match of a rule must meet.

    Taken from comparisons with a number, equalities with a text and BETWEEN that stand under AND
    and quantifiers alone. ``scope`` is the collection of the nearest quantifier, or empty.
    Under OR and NOT nothing is known; ``!=`` bounds nothing.
    """
    usable = (F.col("kind") == "between") | ((F.col("kind") == "cmp") & (F.col("op") != "!=") & (F.col("low").isNotNull() | ((F.col("op") == "=") & F.col("text").isNotNull())))
    leaves = conditions.where(usable).select("rule", "node", "kind", "op", "field", "low", "high", "text", F.posexplode_outer("ancestors").alias("depth", "ancestor"))
    above = conditions.where(F.col("kind").isin(*_INNER)).select("rule", F.col("node").alias("ancestor"), F.col("kind").alias("above"), F.col("field").alias("collection"))
    # nodes are many times what Spark expects of the table they are taken from: neither side may be sent to every task
    met = leaves.join(above.hint("merge"), ["rule", "ancestor"], "left").groupBy("rule", "node").agg(
        *(F.first(c).alias(c) for c in ("kind", "op", "field", "low", "high", "text")), F.count_if(F.col("above").isin("or", "not")).alias("loose"), F.max_by("collection", F.when(F.col("collection").isNotNull(), F.col("depth"))).alias("scope")
    )
    met = met.where("loose = 0")
    low = F.when((F.col("kind") == "between") | F.col("op").isin("=", ">", ">="), F.col("low"))
    high = F.when(F.col("kind") == "between", F.col("high")).when(F.col("op").isin("=", "<", "<="), F.col("low"))
    return met.select(
        "rule", F.coalesce("scope", F.lit("")).alias("scope"), "field", low.alias("low"), F.coalesce(F.col("op") == ">", F.lit(False)).alias("low_open"),
        high.alias("high"), F.coalesce(F.col("op") == "<", F.lit(False)).alias("high_open"), "text",
    )


def _leaf_text() -> Column:
    return F.to_json(F.struct("kind", "op", "field", "low", "high", "text"))


def digests(conditions: DataFrame) -> DataFrame:
    """rule, digest: equal for conditions that differ only in the order, nesting or repetition of what AND and OR join, or in double negation.

    Digests are built level by level from the leaves upward; a level is one grouping of its
    nodes by their parents.
    """
    nodes = conditions.withColumns({"depth": F.size("ancestors"), "parent": F.try_element_at("ancestors", F.lit(-1))})
    deepest = nodes.agg(F.max("depth")).first()[0]
    sha = lambda *parts: F.sha2(F.concat_ws("\u0001", *parts), 256)
    told = ["kind", "parts", "digest", "inner_kind", "inner_parts", "inner_digest"]  # what a node comes to; of a negation also what it denies
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"parts": F.lit(None).cast("array<string>"), "child": F.lit(None).cast("struct<kind:string,parts:array<string>,digest:string,inner_kind:string,inner_parts:array<string>,inner_digest:string>")})
        else:
            # what a child of the same kind joins is joined here as well
            under = below.join(level.select("rule", F.col("node").alias("parent"), F.col("kind").alias("over")).hint("merge"), ["rule", "parent"])
            own = F.when(F.col("kind").isin("and", "or") & (F.col("kind") == F.col("over")), F.col("parts")).otherwise(F.array("digest"))
            joined = under.groupBy("rule", F.col("parent").alias("node")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("parts"), F.min_by(F.struct(*told), "node").alias("child"))
            level = level.join(joined.hint("merge"), ["rule", "node"], "left")
        kind, child = F.col("kind"), F.col("child")
        undone = F.coalesce((kind == "not") & (child["kind"] == "not"), F.lit(False))
        alone = F.coalesce(kind.isin("and", "or") & (F.size("parts") == 1), F.lit(False))
        digest = (
            F.when(kind.isin("and", "or", "not"), sha("kind", F.array_join("parts", "\u0002")))
            .when(kind.isin("exists", "forall"), sha("kind", "field", F.array_join("parts", "\u0002"))).otherwise(sha(_leaf_text()))
        )
        itself = {"kind": kind, "parts": F.col("parts"), "digest": digest} | {f"inner_{c}": F.when(kind == "not", child[c]) for c in ("kind", "parts", "digest")}
        # two negations come to what the inner one denies; one part alone, to that part
        comes = [F.when(undone, child[f"inner_{c}"] if f"inner_{c}" in told else F.lit(None)).when(alone, child[c]).otherwise(itself[c]).alias(c) for c in told]
        below = level.select("rule", "node", "parent", *comes)
    if below is None:
        return conditions.sparkSession.createDataFrame([], "rule string, digest string")
    return below.select("rule", "digest")


#: What ``summaries`` tells of each rule, beside the digest of its condition.
CONSTRAINT = ("scope", "field", "low", "low_open", "high", "high_open", "text")
CONJUNCT = ("conjunct", "part", "leaf", "scope", "field", "low", "low_open", "high", "high_open")


def summaries(conditions: DataFrame) -> DataFrame:
    """rule, how often it comes (copies), condition (as ``digests``), constraints (as ``constraints``) and conjuncts, arrays of structs, from one shuffle of the nodes by their rule.

    Conjuncts are what the canonical condition joins by AND. A row that isn't a ``part`` proves what it says; a conjunct holds
    where one of its rows is proved: for an OR itself or one of its disjuncts. BETWEEN proves its interval, and is two conjuncts.
    A comparison without a value proves nothing.
    """
    leaf = ("kind", "op", "field", "low", "high", "text")
    deepest = conditions.agg(F.max(F.size("ancestors"))).first()[0]
    rows = conditions.groupBy("rule").agg(F.array_sort(F.collect_set(F.struct("node", "ancestors", *leaf))).alias("nodes"), F.count_if(F.size("ancestors") == 0).alias("copies"))
    sha = lambda *parts: F.sha2(F.concat_ws("\u0001", *parts), 256)
    told = ("kind", "parts", "digest", "inner_kind", "inner_parts", "inner_digest")
    names, below = [], None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        def met(n: Column) -> Column:
            kids = F.filter(below, lambda b: b["parent"] == n["node"]) if below else F.lit(None).cast("array<struct<kind:string,parts:array<string>,digest:string,inner_kind:string,inner_parts:array<string>,inner_digest:string>>")
            return F.struct(n.alias("n"), F.when(F.size(kids) > 0, kids).alias("kids"))

        def joined(x: Column) -> Column:
            kind = x["n"]["kind"]
            own = F.transform(x["kids"], lambda b: F.when(kind.isin("and", "or") & (b["kind"] == kind), b["parts"]).otherwise(F.array(b["digest"])))
            return F.struct(x["n"].alias("n"), F.array_sort(F.array_distinct(F.flatten(own))).alias("parts"), F.get(x["kids"], F.lit(0)).alias("child"))

        def named(x: Column) -> Column:
            n, text = x["n"], F.array_join(x["parts"], "\u0002")
            digest = F.when(n["kind"].isin("and", "or", "not"), sha(n["kind"], text)).when(n["kind"].isin("exists", "forall"), sha(n["kind"], n["field"], text)).otherwise(sha(F.to_json(F.struct(*(n[c].alias(c) for c in leaf)))))
            return F.struct(n.alias("n"), x["parts"].alias("parts"), x["child"].alias("child"), digest.alias("digest"))

        def comes(x: Column) -> Column:
            n, child, kind = x["n"], x["child"], x["n"]["kind"]
            undone = F.coalesce((kind == "not") & (child["kind"] == "not"), F.lit(False))
            alone = F.coalesce(kind.isin("and", "or") & (F.size(x["parts"]) == 1), F.lit(False))
            itself = {"kind": kind, "parts": x["parts"], "digest": x["digest"]} | {f"inner_{c}": F.when(kind == "not", child[c]) for c in ("kind", "parts", "digest")}
            all_ = [F.when(undone, child[f"inner_{c}"] if f"inner_{c}" in told else F.lit(None)).when(alone, child[c]).otherwise(itself[c]).alias(c) for c in told]
            return F.struct(n["node"].alias("node"), F.try_element_at(n["ancestors"], F.lit(-1)).alias("parent"), n.alias("own"), *all_)

        level = F.filter("nodes", lambda n: F.size(n["ancestors"]) == depth)
        rows = rows.withColumn(f"level_{depth}", F.transform(F.transform(F.transform(F.transform(level, met), joined), named), comes))
        below = f"level_{depth}"
        names.append(below)
    rows = rows.select("rule", "copies", "nodes", F.get("level_0", F.lit(0)).alias("root"), F.concat(*names).alias("all"))
    parts = F.when(F.col("root.kind") == "and", F.col("root.parts")).otherwise(F.array("root.digest"))
    # of nodes that come to the same, one that says it itself
    rows = rows.withColumn("joins", F.transform(F.filter(parts, lambda k: k.isNotNull()), lambda k: F.get(F.filter("all", lambda b: (b["digest"] == k) & (b["own"]["kind"] == b["kind"])), F.lit(0))))
    return rows.select("rule", "copies", F.col("root.digest").alias("condition"), _constraints_of("nodes").alias("constraints"), F.flatten(F.transform("joins", _conjunct_rows)).alias("conjuncts"))


def _usable(n: Column) -> Column:
    return (n["kind"] == "between") | ((n["kind"] == "cmp") & (n["op"] != "!=") & (n["low"].isNotNull() | ((n["op"] == "=") & n["text"].isNotNull())))


def _bounds(n: Column) -> tuple[Column, Column, Column, Column]:
    low = F.when((n["kind"] == "between") | n["op"].isin("=", ">", ">="), n["low"])
    high = F.when(n["kind"] == "between", n["high"]).when(n["op"].isin("=", "<", "<="), n["low"])
    return low, F.coalesce(n["op"] == ">", F.lit(False)), high, F.coalesce(n["op"] == "<", F.lit(False))


def _constraints_of(nodes: str) -> Column:
    inner = F.filter(nodes, lambda n: n["kind"].isin(*_INNER))

    def stands(n: Column) -> Column:
        return F.struct(n.alias("n"), F.filter(inner, lambda a: F.array_contains(n["ancestors"], a["node"])).alias("above"))

    def row(x: Column) -> Column:
        n = x["n"]
        around = F.transform(F.filter(x["above"], lambda a: a["field"].isNotNull()), lambda a: F.struct(F.size(a["ancestors"]).alias("depth"), a["field"].alias("field")))
        return F.struct(*(c.alias(k) for k, c in zip(CONSTRAINT, (F.coalesce(F.array_max(around)["field"], F.lit("")), n["field"], *_bounds(n), n["text"]), strict=True)))

    strict = F.filter(F.transform(F.filter(nodes, _usable), stands), lambda x: ~F.exists(x["above"], lambda a: a["kind"].isin("or", "not")))
    return F.transform(strict, row)


def _conjunct_rows(b: Column) -> Column:
    """The rows of one conjunct."""
    inf, no = F.lit(float("inf")), F.lit(False)

    def row(conjunct: Column, part: bool, said: Column, n: Column, low: Column, low_open: Column, high: Column, high_open: Column) -> Column:
        bound = _usable(n) & n["low"].isNotNull()
        known = ~n["kind"].isin("cmp", "between") | n["low"].isNotNull() | n["text"].isNotNull()
        values = (
            conjunct, F.lit(part), F.when(known, said), F.lit(""), F.when(bound, n["field"]), F.when(bound, F.coalesce(low, -inf)), F.when(bound, low_open), F.when(bound, F.coalesce(high, inf)), F.when(bound, high_open),
        )
        return F.struct(*(c.cast("string").alias(k) if k in ("conjunct", "leaf") else c.alias(k) for k, c in zip(CONJUNCT, values, strict=True)))

    n, key = b["own"], b["digest"]
    low, low_open, high, high_open = _bounds(n)
    whole = row(key, False, key, n, low, low_open, high, high_open)
    ends = F.array(row(F.lit(None), False, key, n, low, no, high, no), row(F.concat(key, F.lit("<")), True, key, n, -inf, no, high, no), row(F.concat(key, F.lit(">")), True, key, n, low, no, inf, no))
    some = F.filter("all", lambda d: F.array_contains(b["parts"], d["digest"]) & (d["own"]["kind"] == d["kind"]))
    either = F.concat(F.array(whole), F.transform(some, lambda d: row(key, True, d["digest"], d["own"], *_bounds(d["own"]))))
    return F.when(b["kind"] == "between", ends).when(b["kind"] == "or", either).otherwise(F.array(whole))
