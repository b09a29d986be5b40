"""Document pipelines: stages as dicts, run as DataFrame operations.

``run(df, [{"$match": {...}}, {"$group": {...}}, ...], tables)`` returns a
lazy DataFrame. Expressions: ``"$a.b"`` is a field, ``{"$op": args}`` an
operation, anything else a literal.
"""

from __future__ import annotations

from collections.abc import Callable, MutableMapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import cut

_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "$eq": lambda a, b: a.eqNullSafe(b),
    "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
    "$subtract": lambda a, b: a - b,
    "$divide": lambda a, b: a / b,
    "$mod": lambda a, b: a % b,
}
_MANY: dict[str, Callable[[Column, Column], Column]] = {
    "$add": lambda a, b: a + b,
    "$multiply": lambda a, b: a * b,
    "$and": lambda a, b: a & b,
    "$or": lambda a, b: a | b,
}
_ONE: dict[str, Callable[[Column], Column]] = {
    "$not": lambda a: ~a,
    "$size": F.size,
    "$toLower": F.lower,
    "$toUpper": F.upper,
    "$abs": F.abs,
    "$floor": F.floor,
    "$ceil": F.ceil,
}
_GROUP: dict[str, Callable[[Column], Column]] = {
    "$sum": F.sum,
    "$avg": F.avg,
    "$min": F.min,
    "$max": F.max,
    "$push": F.collect_list,
    "$addToSet": F.collect_set,
    "$first": F.first,
    "$last": F.last,
}


def expression(e: Any) -> Column:
    if isinstance(e, Column):
        return e
    if isinstance(e, str) and e.startswith("$"):
        return F.col(e[1:])
    if isinstance(e, dict) and len(e) == 1 and next(iter(e)).startswith("$"):
        op, args = next(iter(e.items()))
        if op == "$literal":
            return F.lit(args)
        if op == "$cond":
            parts = [args[k] for k in ("if", "then", "else")] if isinstance(args, dict) else args
            return F.when(expression(parts[0]), expression(parts[1])).otherwise(expression(parts[2]))
        if op == "$ifNull":
            return F.coalesce(*map(expression, args))
        if op == "$concat":
            return F.concat(*map(expression, args))
        if op in _BINARY:
            return _BINARY[op](*map(expression, args))
        if op in _MANY:
            return reduce(_MANY[op], map(expression, args))
        if op in _ONE:
            return _ONE[op](expression(args[0] if isinstance(args, list) else args))
        raise ValueError(f"unknown operator {op}")
    if isinstance(e, dict):
        return F.struct(*[expression(v).alias(k) for k, v in e.items()])
    if isinstance(e, list):
        return F.array(*map(expression, e))
    return F.lit(e)


def condition(filter_: dict, collation: str | None = None) -> Column:
    """A filter document as a column; null counts as false."""

    def one(field: str, want: Any) -> Column:
        if field in ("$and", "$or", "$nor"):
            parts = reduce(lambda a, b: a & b if field == "$and" else a | b, [condition(w, collation) for w in want])
            return ~parts if field == "$nor" else parts
        if field == "$expr":
            return expression(want)
        c = F.col(field)
        if not (isinstance(want, dict) and want and all(k.startswith("$") for k in want)):
            if collation and isinstance(want, str):
                return F.collate(c, collation) == F.collate(F.lit(want), collation)
            return c.isNull() if want is None else c == want
        out = F.lit(True)
        for op, v in want.items():
            if op == "$in":
                now = reduce(lambda a, b: a | b, [F.collate(c, collation) == F.collate(F.lit(x), collation) for x in v]) if collation else c.isin(*v)
            elif op == "$nin":
                now = ~F.coalesce(c.isin(*v), F.lit(False))
            elif op == "$exists":
                now = c.isNotNull() if v else c.isNull()
            elif op == "$mod":
                now = F.pmod(c, F.lit(v[0])) == v[1]
            elif op == "$regex":
                now = c.rlike(v)
            elif op == "$not":
                now = ~F.coalesce(one(field, v), F.lit(False))
            else:
                now = _BINARY[op](c, F.lit(v))
            out = out & now
        return out

    return F.coalesce(reduce(lambda a, b: a & b, [one(k, v) for k, v in filter_.items()], F.lit(True)), F.lit(False))


def _group(df: DataFrame, spec: dict) -> DataFrame:
    made = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        ((op, arg),) = acc.items()
        made.append(F.count("*").alias(name) if op == "$count" or (op == "$sum" and arg == 1) else _GROUP[op](expression(arg)).alias(name))
    keyed = df.withColumn("_id", expression(spec["_id"]))
    return keyed.groupBy("_id").agg(*made) if made else keyed.select("_id").distinct()


def _bucket(df: DataFrame, spec: dict) -> DataFrame:
    by, edges = expression(spec["groupBy"]), spec["boundaries"]
    at = None
    for lo, hi in zip(edges, edges[1:]):
        here = (by >= lo) & (by < hi)
        at = F.when(here, F.lit(lo)) if at is None else at.when(here, F.lit(lo))
    rest = F.lit(spec["default"]) if "default" in spec else F.raise_error(F.lit("a value lies outside the boundaries"))
    return _group(df.withColumn("_bucket", at.otherwise(rest)), {"_id": "$_bucket"} | spec.get("output", {"count": {"$sum": 1}}))


def _bucket_auto(df: DataFrame, spec: dict) -> DataFrame:
    """Buckets of about even counts; equal values stay together.

    A bucket ends with the value at which its share of the rows is reached.
    Values are counted first, then numbered through the partitions of a range
    sort: one row for each partition reaches the driver.
    """
    n, by = spec["buckets"], expression(spec["groupBy"])
    counts = df.select(by.alias("_by")).where("_by is not null").groupBy("_by").agg(F.count("*").alias("_n"))
    counts = cut(counts.orderBy("_by")).withColumn("_part", F.spark_partition_id())
    sums = sorted((r["_part"], r["n"]) for r in counts.groupBy("_part").agg(F.sum("_n").alias("n")).collect())
    total, before, starts = sum(x for _, x in sums), 0, {}
    for part, x in sums:
        starts[part], before = before, before + x
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_part")) if starts else F.lit(0)
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy("_by").rowsBetween(Window.unboundedPreceding, -1))
    no = F.floor((start + F.coalesce(upto, F.lit(0))) * n / F.lit(total or 1))
    out = counts.withColumn("_no", no).groupBy("_no").agg(F.min("_by").alias("min"), F.max("_by").alias("max"), F.sum("_n").alias("count"))
    return out.select(F.struct("min", "max").alias("_id"), "count")


def _facet(df: DataFrame, spec: dict, tables: dict) -> DataFrame:
    """One row; each branch gathers its rows, so branches should end in few."""
    out = None
    for name, stages in spec.items():
        part = run(df, stages, tables)
        one = part.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in part.columns])).alias(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.agg(*[F.first(name, ignorenulls=True).alias(name) for name in spec])


def _lookup(df: DataFrame, spec: dict, tables: dict) -> DataFrame:
    right, name = tables[spec["from"]], spec["as"]
    rows = right.groupBy(F.col(spec["foreignField"]).alias("_k")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in right.columns])).alias(name))
    empty = F.array().cast(rows.schema[name].dataType)
    return df.join(rows, df[spec["localField"]] == rows["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, empty))


def _graph_lookup(df: DataFrame, spec: dict, tables: dict) -> DataFrame:
    """Reachable documents, breadth first; a frontier holds new pairs only."""
    right, name = tables[spec["from"]], spec["as"]
    node = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    edges = right.select(F.col(spec["connectToField"]).alias("_to"), F.col(spec["connectFromField"]).alias("_from"), node.alias("_node")).where("_to is not null")
    edges = cut(edges)
    starts = df.select(expression(spec["startWith"]).alias("_start")).where("_start is not null").distinct()
    seen = frontier = cut(starts.join(edges, starts["_start"] == edges["_to"]).select("_start", "_from", "_node").distinct())
    depth = 0
    while depth < spec.get("maxDepth", 1 << 30) and not frontier.isEmpty():
        nxt = frontier.select("_start", F.col("_from").alias("_at")).where("_at is not null").distinct()
        found = nxt.join(edges, nxt["_at"] == edges["_to"]).select("_start", "_from", "_node").distinct()
        frontier = found.join(seen, ["_start", "_node"], "left_anti").select("_start", "_from", "_node")
        frontier = cut(frontier)
        seen, depth = seen.unionByName(frontier), depth + 1
    grouped = seen.groupBy("_start").agg(F.collect_set("_node").alias(name))
    empty = F.array().cast(grouped.schema[name].dataType)
    out = df.withColumn("_s", expression(spec["startWith"])).join(grouped, F.col("_s") == F.col("_start"), "left")
    return out.drop("_s", "_start").withColumn(name, F.coalesce(name, empty))


def _redact(df: DataFrame, spec: Any) -> DataFrame:
    """Each level is pruned, kept, or descended into, by its own fields."""
    ((op, (test, yes, no)),) = [(k, [v[x] for x in ("if", "then", "else")] if isinstance(v, dict) else v) for k, v in spec.items()]
    if op != "$cond":
        raise ValueError("$redact takes a $cond")

    def fields_of(e: Any) -> set[str]:
        if isinstance(e, str):
            return {e[1:]} if e.startswith("$") and not e.startswith("$$") else set()
        return set().union(*map(fields_of, e.values() if isinstance(e, dict) else e)) if isinstance(e, (dict, list)) else set()

    def level(get: Callable[[str], Column], struct: T.StructType) -> tuple[Column, dict[str, Column]]:
        names = set(struct.fieldNames())
        gone = {n: F.lit(None) for n in fields_of(test) - names}

        def put(e: Any) -> Any:
            if isinstance(e, str) and e.startswith("$"):
                return gone.get(e[1:], get(e[1:]) if e[1:] in names else None)
            return {k: put(v) for k, v in e.items()} if isinstance(e, dict) else [put(v) for v in e] if isinstance(e, list) else e

        verdict = F.coalesce(expression(put(test)), F.lit(False))
        act = F.when(verdict, F.lit(yes)).otherwise(F.lit(no))
        out = {}
        for f in struct.fields:
            value = get(f.name)
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                value = F.when(act == "$$KEEP", value).otherwise(F.filter(F.transform(value, element(f.dataType.elementType)), lambda x: x.isNotNull()))
            elif isinstance(f.dataType, T.StructType):
                inner, kept = level(lambda n, v=value: v[n], f.dataType)
                deep = F.when(value.isNotNull() & (inner != "$$PRUNE"), F.struct(*[c.alias(n) for n, c in kept.items()]))
                value = F.when(act == "$$KEEP", value).otherwise(deep)
            out[f.name] = value
        return act, out

    def element(struct: T.StructType) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            inner, kept = level(lambda n: x[n], struct)
            return F.when(inner == "$$KEEP", x).when(inner != "$$PRUNE", F.struct(*[c.alias(n) for n, c in kept.items()]))

        return one

    act, out = level(lambda n: F.col(f"`{n}`"), df.schema)
    return df.where(act != "$$PRUNE").select(*[c.alias(n) for n, c in out.items()])


def _great_circle(x: Column, y: Column, lon: float, lat: float, radius: float = 6378100.0) -> Column:
    """Metres between places given as longitude and latitude in degrees."""
    a, b = F.radians(y), F.radians(F.lit(lat))
    h = F.sin((a - b) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin((F.radians(x) - F.radians(F.lit(lon))) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _project(df: DataFrame, spec: dict) -> DataFrame:
    if all(v in (0, False) for v in spec.values()):
        return df.drop(*spec)
    return df.select(*[F.col(k) if v in (1, True) and not isinstance(v, str) else expression(v).alias(k) for k, v in spec.items() if v not in (0, False)])


def _unwind(df: DataFrame, spec: Any) -> DataFrame:
    spec = {"path": spec} if isinstance(spec, str) else spec
    name, at = spec["path"][1:], spec.get("includeArrayIndex")
    keep = spec.get("preserveNullAndEmptyArrays", False)
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    if at:
        return df.select(*rest, (F.posexplode_outer if keep else F.posexplode)(name).alias(at, name))
    return df.select(*rest, (F.explode_outer if keep else F.explode)(name).alias(name))


def _count_by(df: DataFrame, e: Any) -> DataFrame:
    return df.groupBy(expression(e).alias("_id")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "_id")


def merge_into(df: DataFrame, into: DataFrame, on: str) -> DataFrame:
    """An upsert: ``into`` with the rows of ``df`` replaced or added, by key."""
    return into.join(df.select(on), on, "left_anti").unionByName(df, allowMissingColumns=True)


def run(df: DataFrame, stages: list[dict], tables: MutableMapping[str, DataFrame] | None = None, collation: str | None = None) -> DataFrame:
    """Apply the stages in order. ``$out`` and ``$merge`` must be last; they set
    ``tables[name]`` (a write, if ``tables`` is a ``sources.database``) and
    return no rows. Under a collation ``$match`` compares, and ``$sort``,
    ``$group`` and ``$sortByCount`` take strings, by its rules."""
    tables = {} if tables is None else tables
    if collation:
        df = df.withColumns({f.name: F.collate(F.col(f"`{f.name}`"), collation) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
    for i, stage in enumerate(stages):
        ((name, spec),) = stage.items()
        if name in ("$out", "$merge"):
            if i + 1 < len(stages):
                raise ValueError(f"{name} must be the last stage")
            if name == "$out":
                tables[spec] = df
            else:
                into = spec["into"]
                tables[into] = merge_into(df, tables[into], spec.get("on", "_id")) if into in tables else df
            return df.limit(0)
        if name in ("$addFields", "$set"):
            df = df.withColumns({k: expression(v) for k, v in spec.items()})
        elif name == "$bucket":
            df = _bucket(df, spec)
        elif name == "$bucketAuto":
            df = _bucket_auto(df, spec)
        elif name == "$collStats":
            df = df.agg(F.count("*").alias("count"))
        elif name == "$count":
            df = df.agg(F.count("*").alias(spec)).where(F.col(spec) > 0)
        elif name == "$facet":
            df = _facet(df, spec, tables)
        elif name == "$geoNear":
            x, y = (F.get(expression(spec.get("key", "$x")), i) for i in range(2))
            far = _great_circle(x, y, *spec["near"]) if spec.get("spherical") else F.sqrt((x - spec["near"][0]) ** 2 + (y - spec["near"][1]) ** 2)
            if "maxDistance" in spec:
                df = df.where(far <= spec["maxDistance"])
            df = df.withColumn(spec["distanceField"], far).orderBy(spec["distanceField"])
        elif name == "$graphLookup":
            df = _graph_lookup(df, spec, tables)
        elif name == "$group":
            df = _group(df, spec)
        elif name == "$limit":
            df = df.limit(spec)
        elif name == "$lookup":
            df = _lookup(df, spec, tables)
        elif name == "$match":
            df = df.where(condition(spec, collation))
        elif name == "$project":
            df = _project(df, spec)
        elif name == "$redact":
            df = _redact(df, spec)
        elif name == "$replaceRoot":
            root = expression(spec["newRoot"])
            df = df.select(root.alias("_r")).select("_r.*")
        elif name == "$sample":
            df = df.orderBy(F.rand(spec.get("seed", 0))).limit(spec["size"])
        elif name == "$skip":
            df = df.offset(spec)
        elif name == "$sort":
            df = df.orderBy(*[F.col(k).asc() if v == 1 else F.col(k).desc() for k, v in spec.items()])
        elif name == "$sortByCount":
            df = _count_by(df, spec)
        elif name == "$unwind":
            df = _unwind(df, spec)
        else:
            raise ValueError(f"unknown stage {name}")
    return df


def sample_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same in every run: those with the least hashes of the key."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)
