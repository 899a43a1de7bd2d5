"""Problem 1: tables whose fields drift from file to file.

``RescueIngest`` enforces a target schema on JSON lines.  A leaf that the target
does not name, or that cannot be cast to its target type, is kept as it came in
the JSON column ``_rescued``; nothing is dropped.  Fields approved later are
*promoted*: their values are replayed from ``_rescued`` into typed columns.
``drift_report`` compares what consecutive files of a label rescued.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.storage import materialize

TYPES = ("boolean", "integer", "double", "string", "array")
SPARK_TYPE = {"boolean": "boolean", "integer": "bigint", "double": "double", "string": "string", "array": "string"}
RESCUED = "_rescued"
#: Changed fields up to which their hashes (8 bytes each) are sent to every executor.
BROADCAST = 1 << 20
#: Lines that a Python worker holds as Python values at a time.
PIECE = 1000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few lines, whose leaves as Python values need little memory."""
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield b.slice(at, PIECE)


def leaf_type(v) -> str:
    """The drift type of a JSON leaf; ``null`` for null."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "double"
    return "string" if isinstance(v, str) else "array"


def leaves(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Leaf fields of a JSON object by dotted name; arrays are leaves.

    Iterative, so deep nesting cannot exhaust the stack.  An object without
    fields has no leaf.
    """
    stack = [(prefix, obj)]
    while stack:
        pre, o = stack.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                stack.append((f"{pre}{k}.", v))
            else:
                yield pre + k, v


def parse_object(payload: str | None) -> dict | None:
    """The JSON object in a line, or None for blank, broken and other lines."""
    if not payload or not payload.strip():
        return None
    try:
        obj = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return obj if isinstance(obj, dict) else None


def _cast(v, kind: str):
    """``v`` as ``kind`` if that loses nothing, else None (it is then rescued)."""
    if v is None:
        return None
    if kind == "string":
        return v if isinstance(v, str) else None
    if kind == "boolean":
        if isinstance(v, bool):
            return v
        return {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None
    if kind in ("integer", "double"):
        if isinstance(v, bool) or isinstance(v, list):
            return None
        try:
            x = float(v)
        except (ValueError, OverflowError):
            return None
        if kind == "double":
            return x if math.isfinite(x) else None
        if isinstance(v, int):
            return v if -(2**63) <= v < 2**63 else None
        return int(x) if math.isfinite(x) and x == int(x) and abs(x) < 2**53 else None
    return json.dumps(v) if isinstance(v, list) else None


_ARROW = {"boolean": pa.bool_(), "integer": pa.int64(), "double": pa.float64(), "string": pa.string(), "array": pa.string()}


def split_leaves(obj: dict, target: Mapping[str, str]) -> tuple[dict, dict]:
    """The leaves of an object that the target takes, cast, and those to rescue."""
    found, rest = {}, {}
    for name, v in leaves(obj):
        if name in target and (c := _cast(v, target[name])) is not None:
            found[name] = c
        elif name not in target or v is not None:
            rest[name] = v
    return found, rest


def rescue_ingest(lines: DataFrame, target: Mapping[str, str], payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Parse JSON lines into the columns of ``target`` plus ``_rescued``.

    ``target`` maps a dotted field name to one of ``TYPES``; the column is named
    by that dotted name.  ``keep`` are columns of ``lines`` carried along (a
    name that clashes with a target field is an error).  Lines that hold no JSON
    object (null, blank, broken, other JSON) yield no row.  A null leaf gives
    null in a target column and is kept as null among the rescued leaves.
    Repeated lines stay repeated; an empty table gives an empty table.
    """
    if clash := set(keep) & (set(target) | {RESCUED}):
        raise ValueError(f"columns clash with target fields: {sorted(clash)}")
    kept = lines.select(*keep, F.col(payload).alias("_payload"))
    fields = list(target.items())
    arrow = pa.schema([*((k, _ARROW[t]) for k, t in fields), (RESCUED, pa.string())])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_payload"), *(f"`{k}` {SPARK_TYPE[t]}" for k, t in fields), f"`{RESCUED}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            rows, at = {k: [] for k in arrow.names}, []
            for i, text in enumerate(b.column("_payload").to_pylist()):
                if (obj := parse_object(text)) is None:
                    continue
                at.append(i)
                found, rest = split_leaves(obj, target)
                for k, _ in fields:
                    rows[k].append(found.get(k))
                rows[RESCUED].append(json.dumps(rest, ensure_ascii=False))
            take = pa.array(at, pa.int32())
            cols = [b.column(n).take(take) for n in keep] + [pa.array(rows[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *arrow.names])

    return kept.mapInArrow(run, ddl)


def _comparable(v) -> str | None:
    """A leaf's value as text that compares over retyping: a list of one unwrapped, trimmed, lower case, yes as true."""
    if isinstance(v, list) and len(v) == 1 and not isinstance(v[0], (list, dict)):
        v = v[0]
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        t = v.strip().lower()
        return {"yes": "true", "no": "false"}.get(t, t)
    return json.dumps(v, ensure_ascii=False).lower() if isinstance(v, list) else repr(v)


def rescued_leaves(lines: DataFrame, target: Mapping[str, str], payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One row per leaf that ``rescue_ingest`` rescues: ``keep``, the target columns, ``field``, ``type``, ``value``.

    The leaves come from the same parse, so a line is read once.  ``value`` is
    the leaf as text that compares over retyping, null for null.
    """
    if clash := set(keep) & (set(target) | {"field", "type", "value"}):
        raise ValueError(f"columns clash: {sorted(clash)}")
    kept = lines.select(*keep, F.col(payload).alias("_payload"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_payload"), *(f"`{k}` {SPARK_TYPE[t]}" for k, t in target.items()), "`field` string", "`type` string", "`value` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            at, names, kinds, values = [], [], [], []
            typed = {k: [] for k in target}
            for i, text in enumerate(b.column("_payload").to_pylist()):
                if (obj := parse_object(text)) is None:
                    continue
                found, rest = split_leaves(obj, target)
                for k in target:
                    typed[k] += [found.get(k)] * len(rest)
                at += [i] * len(rest)
                for name, v in rest.items():
                    names.append(name)
                    kinds.append(leaf_type(v))
                    values.append(_comparable(v))
            take = pa.array(at, pa.int32())
            cols = [b.column(n).take(take) for n in keep] + [pa.array(typed[k], _ARROW[t]) for k, t in target.items()]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=[*keep, *target, "field", "type", "value"])

    return kept.mapInArrow(run, ddl)


def promote(ingested: DataFrame, approved: Mapping[str, tuple[str, Sequence[str] | Mapping[str, Sequence[str]]]], by: str | None = None, renamed: str | None = None) -> DataFrame:
    """Replay rescued values into typed columns.

    ``approved`` maps a new column to (type, field names it goes by, in order of
    preference); with ``by``, a string column, to (type, those names for each of
    its values; a value without names has none).  With ``renamed``, a column that holds for each row a
    map from field names to the names they go by (a field that it lacks goes by its own), to
    (type, those names for each name they may go by); a row whose map is null has none, and the maps are
    dropped.  A leaf whose value casts leaves ``_rescued``; one that does
    not stays there, so promotion never loses a value.
    """
    src = ingested
    names = [c for c in src.columns if c not in (RESCUED, renamed)]
    if clash := set(approved) & set(src.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in names), *(f"`{k}` {SPARK_TYPE[t]}" for k, (t, _) in approved.items()), f"`{RESCUED}` string"])
    spec = {k: (t, n if by or renamed else {None: n}) for k, (t, n) in approved.items()}

    def run(batches):
        for b in _pieces(batches):
            out = {k: [] for k in spec}
            left = []
            for text, kind, to in zip(b.column(RESCUED).to_pylist(), b.column(by).to_pylist() if by else repeat(None), b.column(renamed).to_pylist() if renamed else repeat(None)):
                rest = json.loads(text) if text else {}
                to = dict(to) if to is not None else None
                for k, (t, alias) in spec.items():
                    got = None
                    if not renamed:
                        own = alias.get(kind, ())
                    else:
                        own = [a for c, among in alias.items() for a in among if a in rest and to.get(a, a) == c] if to is not None else ()
                    for a in own:
                        if a not in rest:
                            continue
                        if rest[a] is None:
                            del rest[a]
                        elif got is None and (c := _cast(rest[a], t)) is not None:
                            got = c
                            del rest[a]
                    out[k].append(got)
                left.append(json.dumps(rest, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(out[k], _ARROW[t]) for k, (t, _) in spec.items()), pa.array(left, pa.string())], names=[*names, *spec, RESCUED])

    return src.mapInArrow(run, ddl)


def united(pairs: Sequence[Sequence[str]], files: Mapping[str, int]) -> dict[str, str]:
    """Each field of renamed pairs and the name it goes by: of those that the pairs connect, the one in most files (ties: the first)."""
    root: dict[str, str] = {}

    def find(f: str) -> str:
        while root.setdefault(f, f) != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for a, b in pairs:
        root[find(a)] = find(b)
    classes: dict[str, list[str]] = {}
    for f in root:
        classes.setdefault(find(f), []).append(f)
    return {f: name for fs in classes.values() for name in (min(fs, key=lambda f: (-files.get(f, 0), f)),) for f in fs}


def file_sequence(specs: DataFrame) -> DataFrame:
    """``label, path, prev_path, file_no`` of each file; prev is the file before it.

    Files are few beside their lines: one window over the list of files.
    """
    w = Window.partitionBy("label").orderBy(F.col("file_no").asc_nulls_last(), "written_at", "path")
    return specs.select("label", "path", "file_no", "written_at").dropDuplicates(["path"]).select("label", "path", F.lag("path").over(w).alias("prev_path"), F.row_number().over(w).alias("seq"))


def drift_report(leaves_df: DataFrame, sequence: DataFrame, keys: Sequence[str], same: float = 0.75, noise: float = 0.1) -> DataFrame:
    """Changes of every file against the one before it.

    ``leaves_df``: ``path``, the ``keys`` and ``field, type, value`` of each leaf
    (a written table: it is read twice); ``sequence``: see ``file_sequence``.  Returns distinct
    ``path, field, change, new_field``.

    * A file has a field if any line has it, null or not.  Its type is that of
      most non-null values (ties: the first in ``TYPES``), else its last type.
    * A vanished and a new field are one renamed field if, over the keys where
      both have a value, at least the share ``same`` agrees; numbers agree
      within the relative ``noise`` of a rerun.  Best pairs are taken first and
      every field is in one pair at most.
    * The first file of a label has no changes; files without lines of JSON
      have no fields.  Empty input gives an empty report.
    """
    profile = leaves_df.groupBy("path", "field").agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in TYPES]
    )
    best = F.greatest(*[F.col(t) for t in TYPES])
    typed = F.when(best > 0, F.coalesce(*[F.when(F.col(t) == best, F.lit(t)) for t in TYPES]))
    profile = profile.select("path", "field", typed.alias("type"))
    seq = sequence.select("label", "path", "prev_path", "seq")
    has = profile.join(seq, "path")  # some fields of each file: few rows from here on
    carried = Window.partitionBy("label", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    has = has.withColumn("type", F.last("type", ignorenulls=True).over(carried)).select("label", "path", "seq", "field", "type")
    has = materialize(has)

    now = has.select("path", "field", F.col("type").alias("now_type"))
    before = has.select(F.col("path").alias("prev_path"), "field", F.col("type").alias("prev_type")).join(seq.filter("prev_path IS NOT NULL").select("prev_path", "path"), "prev_path").select("path", "field", "prev_type", F.lit(1).alias("was"))
    later = seq.filter("prev_path IS NOT NULL").select("path")
    both = now.join(later, "path").withColumn("is", F.lit(1)).join(before, ["path", "field"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("now_type") != F.col("prev_type"), "retyped")
    moved = both.select("path", "field", change.alias("change")).filter("change IS NOT NULL")

    # renames: values of the vanished and the new fields only, by key
    prev = seq.filter("prev_path IS NOT NULL").select("path", "prev_path")
    # only these leaves are read again; a line delivered twice counts once
    moved = materialize(moved)
    gone = moved.filter("change = 'removed'").join(prev, "path").select(F.col("prev_path").alias("path"), F.col("path").alias("at"), "field", F.lit(0).alias("side"))
    new = moved.filter("change = 'added'").select("path", F.col("path").alias("at"), "field", F.lit(1).alias("side"))
    vals = leaves_df.filter("value IS NOT NULL").select("path", *keys, "field", F.col("value").alias("v"))
    wanted = gone.unionByName(new)
    if moved.count() <= BROADCAST:
        # most leaves are of fields that did not move: they are left out before the shuffle, by hash, and the join is exact
        vals = vals.join(F.broadcast(wanted.select(F.xxhash64("path", "field").alias("_h")).distinct()), F.xxhash64("path", "field") == F.col("_h"), "left_semi")
    vals = materialize(vals.join(wanted, ["path", "field"]).groupBy("at", *keys, "side", "field").agg(F.min("v").alias("v")))
    old_vals = vals.filter("side = 0").select("at", *keys, "field", F.col("v").alias("old"))
    new_vals = vals.filter("side = 1").select("at", *keys, F.col("field").alias("new_field"), F.col("v").alias("new"))
    a, b = F.expr("try_cast(old AS double)"), F.expr("try_cast(new AS double)")
    agree = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= noise * F.greatest(F.abs(a), F.abs(b))).otherwise(F.col("old") == F.col("new"))
    pairs = (
        old_vals.join(new_vals, ["at", *keys])
        .groupBy("at", "field", "new_field")
        .agg(F.avg(agree.cast("double")).alias("share"), F.count("*").alias("n"))
        .filter(F.col("share") >= same)
    )

    def best_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the candidate pairs of a file follow each other, the best first; a field is in one pair at most
        now, used = None, set()
        for b in batches:
            keep = []
            for i, (at, f, g) in enumerate(zip(*(b.column(c).to_pylist() for c in ("at", "field", "new_field")))):
                if at != now:
                    now, used = at, set()
                if (0, f) not in used and (1, g) not in used:
                    used |= {(0, f), (1, g)}
                    keep.append(i)
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ("at", "field", "new_field")], names=["at", "field", "new_field"])

    best = pairs.repartition("at").sortWithinPartitions("at", F.desc("share"), F.desc("n"), "field", "new_field")
    taken = materialize(best.mapInArrow(best_first, "at string, field string, new_field string"))
    renamed = taken.select(F.col("at").alias("path"), "field", F.lit("renamed").alias("change"), "new_field")
    rest = moved.join(renamed.select("path", "field", F.lit("removed").alias("change")), ["path", "field", "change"], "left_anti").join(renamed.select("path", F.col("new_field").alias("field"), F.lit("added").alias("change")), ["path", "field", "change"], "left_anti")
    return rest.select("path", "field", "change", F.lit("").alias("new_field")).unionByName(renamed).distinct()
