"""Overlap between rules, from tables of their constraints and canonical conjuncts.

constraints: rule, scope, field, low, low_open, high, high_open, text (NULL bounds are unbounded).
conjuncts: rule, conjunct, leaf (canonical text), scope, field, low, low_open, high, high_open, and ``part`` where a conjunct has
several rows (see ``conditions.summaries``).
rules: rule, condition (canonical text), outcome (canonical text).

Rules that say the same are one class: groups of a class are held against each other where they meet, and pairs of rules
are counted from the sizes of their groups, or written out there where pairs are asked for; no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = {"ExactDuplicate": "redundant", "Shadowed": "conflict", "Subsumption": "redundant", "ConditionOverlap": "overlap"}
_INF = float("inf")


def intervals(constraints: DataFrame) -> DataFrame:
    """One row per rule, scope and field: the tightest bounds; at a tie open wins."""
    low = F.max(F.struct(F.coalesce("low", F.lit(-_INF)).alias("v"), F.coalesce(F.col("low_open").cast("int"), F.lit(0)).alias("open")))
    high = F.min(F.struct(F.coalesce("high", F.lit(_INF)).alias("v"), (-F.coalesce(F.col("high_open").cast("int"), F.lit(0))).alias("open")))
    rows = constraints.groupBy("rule", "scope", "field").agg(low.alias("l"), high.alias("h"), F.min("text").alias("text"), F.max("text").alias("text2"), F.count_if(F.col("text").isNull()).alias("numeric"))
    return rows.select("rule", "scope", "field", F.col("l.v").alias("low"), (F.col("l.open") == 1).alias("low_open"), F.col("h.v").alias("high"), (F.col("h.open") == -1).alias("high_open"), "text", "text2", "numeric")


#: How many rules of a class go together, how many such groups are held against each other at once, and into how many blocks groups are dealt at most.
GROUP, BLOCK, BLOCKS = 1024, 256, 24
_CONJUNCT = ("conjunct", "part", "leaf", "scope", "field", "low", "low_open", "high", "high_open")


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """All that a table says of a rule, as one array."""
    return rows.where("rule is not null").groupBy("rule").agg(F.array_sort(F.collect_set(F.struct(*columns))).alias(name))


def _intervals_of(iv: DataFrame) -> DataFrame:
    return _listed(iv, "iv", *(c for c in iv.columns if c != "rule"))


def _conjuncts_of(conjuncts: DataFrame) -> DataFrame:
    rows = conjuncts if "part" in conjuncts.columns else conjuncts.withColumn("part", F.lit(False))
    return _listed(rows, "cj", *_CONJUNCT)


def _groups(said: DataFrame) -> DataFrame:
    """Rules that say the same, up to GROUP together: id, ``rules`` in order, and what they say. said: rule and what it says."""
    told = [c for c in said.columns if c != "rule"]
    known = said.withColumn("class", F.substring(F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256), 1, 32))
    nth = F.row_number().over(Window.partitionBy("class").orderBy("rule"))
    known = known.withColumn("id", F.concat("class", F.lit("."), F.floor((nth - 1) / GROUP).cast("string")))
    rows = known.groupBy("id").agg(F.sort_array(F.collect_list("rule")).alias("rules"), *(F.first(c).alias(c) for c in told))
    if "iv" in told:
        # the fields that a rule bounds, and those of the claim itself among them, by their hashes; rules that share none can't overlap
        bound = lambda keep: F.coalesce(F.array_compact(F.transform("iv", lambda x: F.when(x["field"].isNotNull() & keep(x), F.xxhash64(x["scope"], x["field"])))), F.array().cast("array<bigint>"))
        rows = rows.withColumns({"keys": bound(lambda x: F.lit(True)), "claim": bound(lambda x: x["scope"] == "")})
    if "cj" in told:
        # a leaf is told by 128 bits of its digest, as groups are sent many times; what bounds a field comes first, as it is most often what isn't proved
        bare = lambda rows: F.transform(rows, lambda c: F.struct(c["field"].isNull().alias("unbound"), F.unhex(F.substring(F.sha2(c["leaf"], 256), 1, 32)).alias("leaf"), *(c[k].alias(k) for k in _CONJUNCT[3:])))
        ids = F.array_distinct(F.array_compact(F.transform("cj", lambda c: c["conjunct"])))
        needs = F.transform(ids, lambda k: bare(F.filter("cj", lambda c: c["conjunct"] == k)))
        ordered = F.array_sort(F.transform(needs, lambda rows: F.struct(((F.size(rows) > 1) | F.get(rows, F.lit(0))["unbound"]).alias("last"), rows.alias("rows"))))
        rows = rows.withColumns({"needs": F.transform(ordered, lambda x: x["rows"]), "proofs": F.array_sort(bare(F.filter("cj", lambda c: ~c["part"])))}).drop("cj")
    # kept: both sides of what follows read it, and it is as large as the rules alone
    return rows.persist()


def _held(left: DataFrame, right: DataFrame, on: tuple[str, str], ordered: bool, where: Callable[[str, str], Column]) -> DataFrame:
    """Groups x of ``left`` and y of ``right`` that share one of the values in the arrays ``on`` and meet ``where``, each pair once: columns x_ and y_.

    Both sides are dealt into blocks, and a pair of blocks with a value is one piece of work, so that nothing is shuffled
    but groups (as often as there are blocks) and no pairs. ordered: (x, y) and (y, x) are two pairs; otherwise both sides are the same groups.
    """
    session = left.sparkSession
    blocks = max(1, min(BLOCKS, -(-max(left.count(), right.count()) // BLOCK)))
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))

    def side(rows: DataFrame, name: str, values: str, own: str, other: str, first: Column, last: Column) -> DataFrame:
        rows = rows.withColumn("on", F.col(values)).withColumn(own, F.pmod(F.hash("id"), F.lit(blocks))).withColumn("value", F.explode("on")).withColumn(other, F.explode(F.sequence(first, last)))
        return rows.select("value", "i", "j", *(F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in ("value", "i", "j"))).repartition(parts, "value", "i", "j")

    end, start = F.lit(blocks - 1), F.lit(0)
    x = side(left, "x", on[0], "i", "j", start if ordered else F.col("i"), end)
    y = side(right, "y", on[1], "j", "i", start, end if ordered else F.col("j"))
    once = F.lit(True) if ordered else (F.col("i") < F.col("j")) | (F.col("x_id") <= F.col("y_id"))
    # at the first value that they share
    met = F.get(F.array_intersect("x_on", "y_on"), F.lit(0)) == F.col("value")
    return x.join(y.hint("merge"), ["value", "i", "j"]).where(once & met & where("x", "y"))


def _fits(a: Column, b: Column) -> Column:
    """Whether two rules' intervals on one field can be met at once."""
    low, high = F.greatest(a["low"], b["low"]), F.least(a["high"], b["high"])
    low_open = (a["low_open"] & (a["low"] == low)) | (b["low_open"] & (b["low"] == low))
    high_open = (a["high_open"] & (a["high"] == high)) | (b["high_open"] & (b["high"] == high))
    both_text = a["text"].isNotNull() & b["text"].isNotNull()
    any_text = a["text"].isNotNull() | b["text"].isNotNull()
    one = (a["text"] == b["text"]) & (a["text"] == a["text2"]) & (b["text"] == b["text2"])
    numbers = (a["numeric"] > 0) | (b["numeric"] > 0)
    return F.when(both_text, one & ~numbers).when(any_text, F.lit(False)).otherwise((low < high) | ((low == high) & ~low_open & ~high_open))


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _overlap(x: str, y: str) -> Column:
    """A shared field that both can meet, and no claim-level field that they can't."""
    same = lambda a, b: (a["scope"] == b["scope"]) & (a["field"] == b["field"])
    meets = F.exists(f"{x}_iv", lambda a: F.exists(f"{y}_iv", lambda b: same(a, b) & _fits(a, b)))
    clash = F.exists(f"{x}_iv", lambda a: F.exists(f"{y}_iv", lambda b: (a["scope"] == "") & same(a, b) & ~_fits(a, b)))
    return _yes(meets) & ~(F.arrays_overlap(f"{x}_claim", f"{y}_claim") & _yes(clash))


def _implies(p: str, q: str) -> Column:
    """Whether every conjunct of q is implied by one of p: the same leaf, or bounds within its own."""

    def proves(a: Column, b: Column) -> Column:
        low = (a["low"] > b["low"]) | ((a["low"] == b["low"]) & (~b["low_open"] | a["low_open"]))
        high = (a["high"] < b["high"]) | ((a["high"] == b["high"]) & (~b["high_open"] | a["high_open"]))
        return (a["leaf"] == b["leaf"]) | ((a["scope"] == b["scope"]) & (a["field"] == b["field"]) & low & high)

    met = F.forall(f"{q}_needs", lambda rows: _yes(F.exists(rows, lambda b: _yes(F.exists(f"{p}_proofs", lambda a: _yes(proves(a, b)))))))
    return _yes(met & (F.size(f"{q}_needs") > 0))


def _expanded(pairs: DataFrame, *columns: str) -> DataFrame:
    """The rules ``one`` and ``other`` of pairs of groups, each pair of different rules."""
    rows = pairs.select(*columns, (F.col("x_id") == F.col("y_id")).alias("itself"), "x_rules", F.explode_outer("y_rules").alias("other"))
    return rows.select(*columns, "itself", "other", F.explode_outer("x_rules").alias("one"))


def _once(pairs: DataFrame, *columns: str) -> DataFrame:
    rows = _expanded(pairs, *columns).where("one < other or (not itself and one <> other)")
    return rows.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), *columns)


def overlapping(iv: DataFrame) -> DataFrame:
    """Pairs (a < b): a shared field that both can meet, and no claim-level field that they can't.

    Rules with the same intervals are one class; groups of classes are held against each other, then their rules written out where they meet.
    """
    groups = _groups(_intervals_of(iv))
    return _once(_held(groups, groups, ("keys", "keys"), False, _overlap))


def _asked(groups: DataFrame) -> DataFrame:
    """What a group asks of those that imply it: its first conjunct, which bounds a field if any does, by its leaves and fields; and what it can prove."""
    says = lambda c: F.array_compact(F.array(F.concat(F.lit("leaf:"), F.hex(c["leaf"])), F.concat(F.lit("field:"), c["scope"], F.lit("\u0001"), c["field"])))
    first = F.get("needs", F.lit(0))
    tokens = lambda rows: F.array_distinct(F.flatten(F.transform(rows, says)))
    return groups.withColumns({"asks": F.coalesce(tokens(first), F.array().cast("array<string>")), "proves": F.coalesce(tokens(F.col("proofs")), F.array().cast("array<string>"))})


def implied(conjuncts: DataFrame) -> DataFrame:
    """Pairs (p, q): every conjunct of q is implied by one of p. Rules with the same conjuncts are one class."""
    groups = _asked(_groups(_conjuncts_of(conjuncts)))
    pairs = _held(groups, groups, ("proves", "asks"), True, _implies)
    return _expanded(pairs).where("one <> other").select(F.col("one").alias("p"), F.col("other").alias("q"))


def classed(rules: DataFrame, conjuncts: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of rules that say the same, and the levels between such groups (columns x_ and y_, level, tier), each pair once and one with itself.

    A group of one rule has no pair with itself.
    """
    hint = lambda rows: rows.hint("merge")
    known = rules.where("rule is not null").join(hint(_intervals_of(intervals(constraints))), "rule", "left").join(hint(_conjuncts_of(conjuncts)), "rule", "left")
    groups = _groups(known.select("rule", "iv", "cj", "condition", "outcome"))
    # what bounds a field can only be implied by what bounds the same
    need = F.get("needs", F.lit(0))
    groups = groups.withColumn("need", F.when((F.size(need) == 1) & F.get(need, F.lit(0))["field"].isNotNull(), F.xxhash64(F.get(need, F.lit(0))["scope"], F.get(need, F.lit(0))["field"])))
    same = _yes(F.col("x_condition") == F.col("y_condition"))
    may = lambda p, q: F.coalesce(F.array_contains(f"{p}_claim", F.col(f"{q}_need")), F.lit(True)) & _implies(p, q)
    imp = may("x", "y") | may("y", "x")
    equal = F.col("x_outcome") == F.col("y_outcome")
    level = F.when(same & equal, "ExactDuplicate").when(same, "Shadowed").when(imp, F.when(equal, "Subsumption").otherwise("Shadowed"))
    said = ["x_id", "x_rules", "y_id", "y_rules"]
    # taken out of an array: a plain filter on the level would make it twice
    found = _held(groups, groups, ("keys", "keys"), False, lambda x, y: F.lit(True))
    found = found.select(*said, F.explode_outer(F.array(F.coalesce(level, F.when(_overlap("x", "y"), "ConditionOverlap")))).alias("level")).where("level is not null")
    # rules that bound no field of the claim can only be implied, or say the same, by their leaves; who shares a field was met above
    free = F.size("claim") == 0
    alone = groups.where(free)
    if not alone.isEmpty():
        mark = lambda rows: rows.withColumns({"free": free, "asks": F.array_append("asks", F.concat(F.lit("is:"), "condition")), "proves": F.array_append("proves", F.concat(F.lit("is:"), "condition"))})
        asked = mark(_asked(groups))
        back = F.col("x_free") & (same | _implies("y", "x")) & (F.col("x_id") > F.col("y_id"))
        more = _held(asked, asked.where("free"), ("proves", "asks"), True, lambda x, y: ~F.arrays_overlap("x_keys", "y_keys") & (same | _implies(x, y)) & ~back)
        found = found.unionByName(more.select(*said, level.alias("level")))
    tier = F.create_map(*(F.lit(v) for kv in TIERS.items() for v in kv))
    return groups, found.withColumn("tier", F.element_at(tier, F.col("level")))


def levels(rules: DataFrame, conjuncts: DataFrame, constraints: DataFrame) -> DataFrame:
    """a, b, level, tier: the most specific level of each pair of rules that has one."""
    return _once(classed(rules, conjuncts, constraints)[1], "level", "tier")


def _sized(pairs: DataFrame) -> DataFrame:
    """Pairs of groups with the number of pairs of rules that each stands for, where there are any."""
    x, y = F.size("x_rules").cast("long"), F.size("y_rules").cast("long")
    return pairs.withColumn("n", F.when(F.col("x_id") == F.col("y_id"), F.floor(x * (x - 1) / 2)).otherwise(x * y)).where("n > 0")


def tiers(rules: DataFrame, conjuncts: DataFrame, constraints: DataFrame) -> DataFrame:
    """tier, n: the pairs of rules of each tier, counted without writing them out."""
    return _sized(classed(rules, conjuncts, constraints)[1]).groupBy("tier").agg(F.sum("n").alias("n"))


def faulty(rules: DataFrame, conjuncts: DataFrame, constraints: DataFrame) -> DataFrame:
    """The rules that are redundant with another one or conflict with it."""
    groups, pairs = classed(rules, conjuncts, constraints)
    bad = _sized(pairs.where("tier <> 'overlap'")).select(F.explode(F.array("x_id", "y_id")).alias("id")).distinct()
    return groups.join(bad.hint("merge"), "id", "left_semi").select(F.explode("rules").alias("rule"))


def partners(rules: DataFrame, conjuncts: DataFrame, constraints: DataFrame) -> DataFrame:
    """a, n_pairs: how many rules after rule a have a level with it, where there are any.

    Of two groups that meet, the rules of both are put in one order where they meet, which tells how many of the one come after each
    of the other; only sums by rule are shuffled. Outcomes tell levels apart, not whether there is one.
    """
    _, pairs = classed(rules.withColumn("outcome", F.lit(None).cast("string")), conjuncts, constraints)

    def after(mine: str, others: str) -> Column:
        """Each rule of one group with the number of rules of the other after it."""
        order = F.sort_array(F.concat(F.transform(mine, lambda r: F.struct(r.alias("rule"), F.lit(1).alias("own"))), F.transform(others, lambda r: F.struct(r.alias("rule"), F.lit(0).alias("own")))))
        own = F.filter(F.transform(order, lambda x, i: F.struct(x["rule"].alias("rule"), x["own"].alias("own"), i.alias("at"))), lambda x: x["own"] == 1)
        # before it stand its k equals in its own group, and the rest are the other's
        return F.transform(own, lambda x, k: F.struct(x["rule"].alias("rule"), (F.size(others) - (x["at"] - k)).alias("n")))

    both = F.when(F.col("x_id") == F.col("y_id"), after("x_rules", "x_rules")).otherwise(F.concat(after("x_rules", "y_rules"), after("y_rules", "x_rules")))
    rows = pairs.select(F.explode_outer(both).alias("r")).groupBy(F.col("r.rule").alias("a")).agg(F.sum("r.n").cast("long").alias("n_pairs"))
    return rows.where("n_pairs > 0")


def cofiring(matched: DataFrame) -> DataFrame:
    """For rule pairs over matched(claim_key, rules): claims matched by both and by each, and their Jaccard similarity.

    ``rules`` are the distinct names of a claim's matched rules, sorted; a claim has at most one
    entry a rule, so pairs are made within its row and only their counts are shuffled.
    """
    # outer: a plain explode would first filter claims by the size of their rules, and so judge the rules twice
    pairs = matched.select(F.explode_outer("rules").alias("a"), "rules").select("a", F.explode_outer("rules").alias("b")).where("a <= b")
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n_both"))
    # a rule with itself counts its claims: one row a pair of rules is left here
    alone = F.when(F.col("a") == F.col("b"), F.col("n_both"))
    counted = both.withColumns({"n_a": F.max(alone).over(Window.partitionBy("a")), "n_b": F.max(alone).over(Window.partitionBy("b"))}).where("a < b")
    return counted.select("a", "b", "n_both", "n_a", "n_b", F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 4).alias("jaccard"))
