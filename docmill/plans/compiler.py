"""Syntax trees to DataFrame programs. All rewriting happens here; Catalyst does the rest."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, registry
from ..functions.registry import Context, Function
from ..functions.values import (
    BOOL, DOUBLE, LONG, TEXT, QueryError, Value, arithmetic, array, as_time, bitwise, common, common_of, compare, conform, constant,
    either, equal, field_of, materialised, predicate, storable, struct, text, truthy,
)
from ..lang import tree as t
from ..sources.checkpoints import saved
from .aggregates import NAMES, OVER_ARRAYS, aggregate, of_nothing

HIDDEN = "__"
TABLE_FUNCTIONS = ("FULLTEXT", "HYBRID_SEARCH", "VECTOR_HYBRID_SEARCH", "FUSION_SEARCH", "VECTOR_SEARCH", "VECTOR_QUERY", "ANN_SEARCH", "SAMPLE")
_numbers = itertools.count()


def fresh(what: str) -> str:
    return f"{HIDDEN}{what}{next(_numbers)}"


@dataclass(frozen=True)
class Frame:
    """A DataFrame with a column per variable.

    `keys` are hidden columns that groupings must keep apart. `known` has hidden columns by the expression and type that
    they hold: joins and windows over the same expression then share its column, and with it Spark's partitioning.
    """

    df: DataFrame
    types: dict[str, T.DataType] = field(default_factory=dict)
    keys: tuple[str, ...] = ()
    started: bool = False
    known: dict[tuple, tuple[str, ...]] = field(default_factory=dict)

    def value(self, name: str) -> Value:
        return Value(F.col(f"`{name}`"), self.types[name])

    @property
    def scope(self) -> dict[str, Value]:
        return {n: self.value(n) for n in self.types}

    def having(self, **columns: Value) -> Frame:
        stored = {n: materialised(v) for n, v in columns.items()}
        return replace(self, df=self.df.withColumns({n: v.col for n, v in stored.items()}), types=self.types | {n: v.type for n, v in stored.items()})

    def where(self, c: Column) -> Frame:
        return replace(self, df=self.df.where(c))

    def holding(self, wanted: dict[tuple, list[Column]]) -> tuple[Frame, dict[tuple, tuple[str, ...]]]:
        """The frame with hidden columns for what is wanted, and their names."""
        there = set(self.df.columns)
        names = {k: self.known[k] if k in self.known and set(self.known[k]) <= there else tuple(fresh("h") for _ in cols) for k, cols in wanted.items()}
        new = {n: c for k, cols in wanted.items() for n, c in zip(names[k], cols, strict=True) if n not in there}
        return replace(self, df=self.df.withColumns(new) if new else self.df, known=self.known | names), names


def document(df: DataFrame, name: str) -> Frame:
    """A table as one struct column."""
    return Frame(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)), {name: df.schema}, (), True)


def conjuncts(e: t.Node) -> list[t.Node]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, t.Binary) and e.op == "AND" else [e]


def conjunction(parts: list[t.Node]) -> t.Node:
    out = parts[0]
    for p in parts[1:]:
        out = t.Binary("AND", out, p)
    return out


def uses(name: str, trees) -> int:
    return sum(isinstance(n, t.Var) and n.name == name for n in t.walk(trees))


def own_names(query: t.Query) -> set[str]:
    """Variables that a query's own clauses make."""
    out: set[str] = set()
    for c in query.body:
        if isinstance(c, t.For):
            out.add(c.var)
        elif isinstance(c, (t.Traverse, t.ShortestPath)):
            out |= {c.var, *([c.edge] if c.edge else [])}
        elif isinstance(c, t.Let):
            out |= {n for n, _ in c.items}
        elif isinstance(c, t.Join):
            out.add(c.collection)
        elif isinstance(c, t.Collect):
            out |= {n for n, _ in c.keys} | {a.var for a in c.aggregates} | {x for x in (c.into, c.count) if x}
    return out


class Compiler:
    """Compiles queries against a catalog: an object with table(name) -> DataFrame and has(name) -> bool."""

    def __init__(self, spark, catalog, binds: dict | None = None, flat_joins: bool = False):
        self.spark, self.catalog, self.binds, self.flat_joins = spark, catalog, binds or {}, flat_joins

    # -- queries

    def run(self, query: t.Query) -> DataFrame:
        """The result of RETURN: columns of an object or document, else one column `value`."""
        distinct = isinstance(query.returns, t.Call) and query.returns.name == "__DISTINCT"
        if distinct:
            query = replace(query, returns=query.returns.args[0])
        frame, returns = self.body(query, Frame(self.spark.range(1).select(), {}))
        frame, returns = self.ordered(frame, query, returns)
        if isinstance(returns, t.Obj) and returns.items and len({k.lower() for k, _ in returns.items}) == len(returns.items):
            # Renamed afterwards: a variable inside a lambda would else be taken for the new column of the same name.
            cols = [materialised(self.expr(e, frame.scope)).col.alias(f"{HIDDEN}out{i}") for i, (_, e) in enumerate(returns.items)]
            df = frame.df.select(*cols).toDF(*(k for k, _ in returns.items))
        else:
            v = materialised(self.expr(returns, frame.scope))
            df = frame.df.select(v.col.alias("value"))
            df = df.select("value.*") if isinstance(v.type, T.StructType) and v.type.fields else df
        return df.distinct() if distinct else df

    def body(self, query: t.Query, frame: Frame) -> tuple[Frame, t.Node]:
        """All clauses before SORT; RETURN as rewritten on the way."""
        clauses, tail = list(query.body), t.Query((), query.sort, query.offset, query.limit, query.returns)
        while clauses:
            clause = clauses.pop(0)
            rest = t.Query(tuple(clauses), tail.sort, tail.offset, tail.limit, tail.returns)
            if isinstance(clause, t.For) and frame.started and clauses and isinstance(clauses[0], t.Filter) and self.is_table(clause.source, frame):
                frame = self.joined_for(frame, clause, clauses.pop(0).test)
                continue
            if isinstance(clause, t.Collect):
                clause, rest = self.lean_collect(clause, rest)
            elif isinstance(clause, t.Join):
                frame, rest = self.join(frame, clause, rest)
                clauses, tail = list(rest.body), rest
                continue
            frame = self.clause(frame, clause)
            clauses, tail = list(rest.body), rest
        query.extra["sort"], query.extra["limits"] = tail.sort, (tail.offset, tail.limit)
        return frame, tail.returns

    def ordered(self, frame: Frame, query: t.Query, returns: t.Node) -> tuple[Frame, t.Node]:
        """SORT, then windows, then LIMIT."""
        sort = query.extra.get("sort", query.sort)
        keys = []
        for e, rising in sort:
            frame, e = self.hoisted(frame, e)
            v = self.expr(e, frame.scope)
            keys.append(v.col.asc_nulls_first() if rising else v.col.desc_nulls_last())
        frame, returns = self.hoisted(frame, returns)
        frame, returns = self.with_windows(frame, returns, keys)
        if keys:
            frame = replace(frame, df=frame.df.orderBy(*keys))
        offset, limit = query.extra.get("limits", (query.offset, query.limit))
        if offset is not None:
            frame = replace(frame, df=frame.df.offset(self.whole(offset)))
        if limit is not None:
            frame = replace(frame, df=frame.df.limit(self.whole(limit)))
        return frame, returns

    def whole(self, e: t.Node) -> int:
        v = self.expr(e, {})
        if v.constant:
            return max(0, int(v.literal)) if isinstance(v.literal, (int, float)) and not isinstance(v.literal, bool) else 0
        row = self.spark.range(1).select(v.col.try_cast("int").alias("n")).first()
        return max(0, row.n or 0)

    # -- clauses

    def is_table(self, source: t.Node, frame: Frame) -> bool:
        return isinstance(source, t.Var) and source.name not in frame.types and self.catalog.has(source.name)

    def clause(self, frame: Frame, c: t.Node) -> Frame:
        if isinstance(c, t.For):
            return self.for_(frame, c)
        if isinstance(c, t.Filter):
            return self.filter(frame, c.test)
        if isinstance(c, t.Let):
            for name, e in c.items:
                frame, e = self.hoisted(frame, e)
                frame = frame.having(**{name: self.expr(e, frame.scope)})
            return frame
        if isinstance(c, t.Collect):
            return self.collect(frame, c)
        if isinstance(c, (t.Traverse, t.ShortestPath)):
            from ..operators import graph

            return graph.compile_clause(self, frame, c)
        if isinstance(c, t.Windowed):
            raise QueryError("WINDOW belongs to CREATE STREAM")
        raise QueryError(f"{type(c).__name__} is not a clause of a read-only query")

    def for_(self, frame: Frame, c: t.For) -> Frame:
        if self.is_table(c.source, frame):
            side = document(self.catalog.table(c.source.name), c.var)
            return self.crossed(frame, side)
        if isinstance(c.source, t.Call) and c.source.name in (*TABLE_FUNCTIONS, "VECTOR_INDEX_STATS"):
            return self.crossed(frame, document(self.found(c.source), c.var))
        if isinstance(c.source, t.Binary) and c.source.op == ".." and not frame.started:
            low, high = (self.expr(e, {}) for e in (c.source.left, c.source.right))
            if low.constant and high.constant:
                df = self.spark.range(int(low.literal), max(int(high.literal) + 1, int(low.literal))).select(F.col("id").alias(c.var))
                return self.crossed(frame, Frame(df, {c.var: LONG}, (), True))
        if isinstance(c.source, t.Var) and c.source.name not in frame.types:
            raise QueryError(f"no collection or variable {c.source.name}")
        frame, source = self.hoisted(frame, c.source)
        v = self.expr(source, frame.scope)
        if not v.is_array:
            v = array([v])
        name, element = fresh("for"), v.element
        df = frame.df.select("*", F.explode(v.col).alias(name)).withColumn(c.var, F.col(name)).drop(name)
        return replace(frame, df=df, types=frame.types | {c.var: element}, started=True)

    def found(self, c: t.Call) -> DataFrame:
        """Rows of a search function; its arguments are constants."""
        from ..operators import search

        values = [self.expr(a, {}) for a in c.args]
        args = [self.plain(v) for v in values]
        df = self.catalog.table(str(args[0]))
        if c.name == "SAMPLE":
            return df.orderBy(F.rand()).limit(int(args[1]))
        if c.name == "FULLTEXT":
            return search.fulltext(df, args[1], args[2], int(args[3]) if len(args) > 3 else 2)
        if c.name == "VECTOR_INDEX_STATS":
            return search.vector_stats(df, str(args[1]))
        if c.name in ("HYBRID_SEARCH", "VECTOR_HYBRID_SEARCH", "FUSION_SEARCH"):
            vector_field = str(args[1]) if str(args[1]) in df.columns else next(f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType))
            options = args[5] if len(args) > 5 else {}
            return search.hybrid_search(df, "_key", vector_field, args[3], str(args[2]), str(args[4]), **{k: v for k, v in options.items() if k in ("vector_weight", "text_weight", "limit", "fusion")})
        rows = search.vector_search(df, str(args[1]), args[2], int(args[3]) if len(args) > 3 else 10, str(args[4]) if len(args) > 4 else "cosine")
        return rows.select(F.struct(*(F.col(f"`{x}`") for x in df.columns)).alias("doc"), "score")

    def plain(self, v: Value):
        """The Python value of a constant expression."""
        if v.constant:
            return v.literal
        row = self.spark.range(1).select(v.col.alias("v")).first().v
        return row.asDict(recursive=True) if hasattr(row, "asDict") else row

    def documents(self, e: t.Call) -> t.Node:
        """DOCUMENT(id), DOCUMENT([ids]), DOCUMENT(collection, key) and DOCUMENT(collection, [keys]) as subqueries."""
        if len(e.args) == 2:
            collection, key = str(self.plain(self.expr(e.args[0], {}))), e.args[1]
        else:
            ids = self.plain(self.expr(e.args[0], {}))
            first = ids[0] if isinstance(ids, (list, tuple)) else ids
            collection = str(first).partition("/")[0]
            keys = [str(i).rpartition("/")[2] for i in ids] if isinstance(ids, (list, tuple)) else str(ids).rpartition("/")[2]
            key = t.Arr(tuple(t.Lit(k) for k in keys)) if isinstance(keys, list) else t.Lit(keys)
        many = isinstance(key, t.Arr) or (isinstance(key, t.Bind) and isinstance(self.binds.get(key.name), (list, tuple)))
        name = fresh("doc")
        of = t.Field(t.Var(name), "_key")
        test = t.Binary("IN", of, key) if many else t.Binary("==", of, key)
        sub = t.Sub(t.Query((t.For(name, t.Var(collection)), t.Filter(test)), returns=t.Var(name)))
        return sub if many else t.Call("FIRST", (sub,))

    def documents_hoisted(self, frame: Frame, e: t.Node) -> tuple[Frame, t.Node]:
        """e with DOCUMENT calls on constants as subqueries, and those on values of rows as variables of the frame."""
        state = [frame]

        def change(n: t.Node) -> t.Node | None:
            if not (isinstance(n, t.Call) and n.name == "DOCUMENT"):
                return None
            if not t.free_names(n.args[-1]):
                return self.documents(n)
            state[0], key = self.hoisted(state[0], n.args[-1])
            collection = None if len(n.args) == 1 else str(self.plain(self.expr(n.args[0], {})))
            state[0], name = self.attach_documents(state[0], self.expr(key, state[0].scope), collection)
            return t.Var(name)

        changed = t.rewrite(e, change)
        return state[0], changed

    def attach_documents(self, frame: Frame, ids: Value, collection: str | None) -> tuple[Frame, str]:
        """A column with the document of each row's id, or of each of its ids; an array leaves out what isn't there.

        Without a collection an id is `collection/key`. Ids are looked up once each: rows of the same id, or the same
        array of ids, meet the same result.
        """
        from ..operators import graph

        name, wanted = fresh("doc"), fresh("id")
        if not (ids.is_text or ids.is_array):
            return frame.having(**{name: constant(None)}), name
        whole = (lambda c: c) if collection is None else lambda c: F.concat(F.lit(f"{collection}/"), c.cast("string"))
        frame = replace(frame, df=frame.df.withColumn(wanted, ids.col))
        asked = frame.df.select(wanted).where(F.col(wanted).isNotNull()).distinct()
        if not ids.is_array:
            found, type_ = graph.with_documents(self.catalog, asked.withColumn("__full", whole(F.col(wanted))), "__full", name, [collection] if collection else None)
            df = frame.df.join(found.groupBy(wanted).agg(F.first(name).alias(name)), wanted, "left").drop(wanted)
            return replace(frame, df=df, types=frame.types | {name: type_}), name
        each = asked.select(wanted, F.posexplode(wanted).alias("__at", "__one")).withColumn("__full", whole(F.col("__one").cast("string")))
        found, type_ = graph.with_documents(self.catalog, each, "__full", name, [collection] if collection else None)
        ordered = F.array_sort(F.collect_list(F.struct("__at", F.col(name).alias("v"))), lambda a, b: a["__at"] - b["__at"])
        lists = found.dropDuplicates([wanted, "__at"]).groupBy(wanted).agg(F.transform(ordered, lambda x: x["v"]).alias(name))
        none = F.when(F.col(wanted).isNotNull(), F.array().cast(T.ArrayType(type_)))
        df = frame.df.join(lists, wanted, "left").withColumn(name, F.coalesce(name, none)).drop(wanted)
        return replace(frame, df=df, types=frame.types | {name: T.ArrayType(type_)}), name

    def counted(self, e: t.Call) -> t.Node | None:
        """COLLECTION_COUNT as a subquery, so that nothing is counted while compiling."""
        name = str(self.plain(self.expr(e.args[0], {}))) if not t.free_names(e.args[0]) else None
        return t.Call("LENGTH", (t.Sub(t.Query((t.For("__c", t.Var(name)),), returns=t.Lit(1))),)) if name and self.catalog.has(name) else None

    @staticmethod
    def crossed(frame: Frame, side: Frame, on: Column | None = None) -> Frame:
        if not frame.types and not frame.keys and not frame.started:
            return side if on is None else side.where(on)
        df = frame.df.crossJoin(side.df) if on is None else frame.df.join(side.df, on)
        return Frame(df, frame.types | side.types, frame.keys, True, frame.known)

    def joined_for(self, frame: Frame, c: t.For, test: t.Node) -> Frame:
        """Nested FOR and its FILTER as a join: Catalyst sees the equalities as keys."""
        side = document(self.catalog.table(c.source.name), c.var)
        plain, later = [], []
        for part in conjuncts(test):
            (later if any(isinstance(n, t.Sub) for n in t.walk(part)) else plain).append(part)
        scope = frame.scope | side.scope
        on = None
        for part in plain:
            test_col = predicate(self.expr(part, scope, safe=True, filtering=True))
            on = test_col if on is None else on & test_col
        frame = self.crossed(frame, side, on)
        return self.filter(frame, conjunction(later)) if later else frame

    def filter(self, frame: Frame, test: t.Node) -> Frame:
        for part in conjuncts(test):
            if (semi := self.semi_join(frame, part)) is not None:
                frame = semi
                continue
            frame, part = self.hoisted(frame, part)
            frame = frame.where(predicate(self.expr(part, frame.scope, safe=True, filtering=True)))
        return frame

    # -- grouping

    def lean_collect(self, c: t.Collect, rest: t.Query) -> tuple[t.Collect, t.Query]:
        """INTO g whose later uses are all F(g[*].v.x) or LENGTH(g): aggregates instead of arrays of rows."""
        if c.into is None:
            return c, rest
        made: list[t.Aggregate] = []
        changed = self.aggregated_uses(c.into, rest, made, lambda path: _path(t.Var(path[0]), path[1:]) if path else None)
        if changed is None:
            return c, rest
        return replace(c, into=None, aggregates=c.aggregates + tuple(made)), changed

    def aggregated_uses(self, name: str, rest: t.Query, made: list[t.Aggregate], element) -> t.Query | None:
        """rest with every F(name[*].path) replaced by a variable, described in made; None if name is used otherwise."""
        if not uses(name, rest):
            return None
        known: dict[tuple[str, tuple[str, ...]], str] = {}

        def change(n: t.Node) -> t.Node | None:
            if not (isinstance(n, t.Call) and len(n.args) == 1 and n.name in OVER_ARRAYS):
                return None
            arg = n.args[0]
            path = arg.path if isinstance(arg, t.Spread) and arg.base == t.Var(name) and arg.path else () if arg == t.Var(name) else None
            if path is None or (not path and OVER_ARRAYS[n.name] != "ROWS"):
                return None
            kind = OVER_ARRAYS[n.name]
            key = (kind, () if kind == "ROWS" else path)
            if key not in known:
                known[key] = fresh("agg")
                made.append(t.Aggregate(known[key], kind, None if kind == "ROWS" else element(path)))
            return t.Var(known[key])

        changed = t.rewrite(rest, change)
        return None if uses(name, changed) else changed

    def collect(self, frame: Frame, c: t.Collect) -> Frame:
        keys: dict[str, Value] = {}
        for name, e in c.keys:
            frame, e = self.hoisted(frame, e)
            keys[name] = materialised(self.expr(e, frame.scope))
        aggregates: dict[str, Value] = {}
        kinds = ["LIST"] * bool(c.into) + ["ROWS"] * bool(c.count) + [NAMES.get(a.func, a.func) for a in c.aggregates]
        if c.into:
            row = struct({n: frame.value(n) for n in frame.types if not n.startswith(HIDDEN)})
            aggregates[c.into] = aggregate("LIST", row)
        if c.count:
            aggregates[c.count] = aggregate("ROWS", None)
        for a in c.aggregates:
            kind = NAMES.get(a.func, a.func)
            arg = None
            if a.arg is not None:
                frame, e = self.hoisted(frame, a.arg)
                arg = self.expr(e, frame.scope)
            aggregates[a.var] = aggregate(kind, arg)
        hidden = [F.col(k) for k in frame.keys]
        group = [v.col.alias(n) for n, v in keys.items()] + hidden
        types = {n: v.type for n, v in (keys | aggregates).items()} | {k: frame.types[k] for k in frame.keys}
        if not aggregates:
            if group:
                return Frame(frame.df.select(*group).distinct(), types, frame.keys, True)
            return Frame(frame.df.limit(1).select(), types, (), True)
        made = [v.col.alias(n) for n, v in aggregates.items()]
        if group:
            return Frame(frame.df.groupBy(*group).agg(*made), types, frame.keys, True)
        some = fresh("rows")
        distinct = [v.col.alias(n) for (n, v), kind in zip(aggregates.items(), kinds, strict=True) if kind == "DISTINCT"]
        if len(distinct) < 2:
            distinct = []
        # Several distinct counts in one aggregation would copy every row for each; alone each is a small pre-aggregation.
        plain = [v.col.alias(n) for (n, v), kind in zip(aggregates.items(), kinds, strict=True) if not distinct or kind != "DISTINCT"]
        df = frame.df.agg(*plain, F.count(F.lit(1)).alias(some)).where(F.col(some) > 0).drop(some)
        for one in distinct:
            df = df.crossJoin(frame.df.agg(one))
        return Frame(df.select(*aggregates), types, (), True)

    # -- joins

    def equi(self, parts: list[t.Node], left: dict[str, Value], right: dict[str, Value]) -> tuple[list[tuple[t.Node, t.Node]], list[t.Node]]:
        """Of conjuncts, the equalities between a left and a right expression, and the others."""
        pairs, others = [], []
        for p in parts:
            if isinstance(p, t.Binary) and p.op == "==":
                a, b = t.free_names(p.left), t.free_names(p.right)
                if a and b and a <= left.keys() and b <= right.keys() and not (a & right.keys()):
                    pairs.append((p.left, p.right))
                    continue
                if a and b and b <= left.keys() and a <= right.keys() and not (b & right.keys()):
                    pairs.append((p.right, p.left))
                    continue
            others.append(p)
        return pairs, others

    def join(self, frame: Frame, c: t.Join, rest: t.Query) -> tuple[Frame, t.Query]:
        """JOIN groups matches into an array; `flat_joins` multiplies rows instead.

        The right side is grouped by its key before the join, so that rows aren't multiplied and one shuffle of each side
        suffices; where later clauses only aggregate the array, the array is never built.
        """
        name = c.collection
        right = document(self.catalog.table(name), name)
        left_scope = {k: v for k, v in frame.scope.items() if k != name}
        pairs, others = self.equi(conjuncts(c.on), left_scope, right.scope)
        if self.flat_joins:
            return self.flat_join(frame, c, right), rest
        if not frame.types:
            raise QueryError("JOIN needs a FOR before it")
        if c.kind == "RIGHT":
            return self.right_join(frame, c, right, pairs, others), rest
        if not pairs or any(t.free_names(o) - {name} for o in others):
            return self.theta_join(frame, c, right), rest
        for o in others:
            right = right.where(predicate(self.expr(o, right.scope, safe=True, filtering=True)))
        made: list[t.Aggregate] = []
        changed = None if c.kind == "FULL" else self.aggregated_uses(name, rest, made, lambda path: _path(t.Var(name), path))
        sides = [(self.expr(a, frame.scope), self.expr(b, right.scope)) for a, b in pairs]
        frame, keys = self.join_keys(frame, [a for a, _ in pairs], sides)
        if changed is not None:
            kinds = {a.var: (a.func, aggregate(a.func, None if a.arg is None else self.expr(a.arg, right.scope))) for a in made}
        else:
            kinds = {name: ("LIST", aggregate("LIST", right.value(name)))}
        keyed = right.df.select(*(k.made.alias(k.right) for k in keys), name)
        grouped = keyed.groupBy(*(k.right for k in keys)).agg(*(v.col.alias(n) for n, (_, v) in kinds.items()))
        if c.kind == "FULL":
            return self.full_join(frame, keyed, grouped, keys, name, kinds[name][1].type), rest
        df = frame.df.join(grouped, [k.on for k in keys], "inner" if c.kind == "INNER" else "left").drop(*(k.right for k in keys))
        fills = {n: F.coalesce(F.col(n), empty) for n, (kind, v) in kinds.items() if (empty := of_nothing(kind, v.type)) is not None and c.kind == "LEFT"}
        df = df.withColumns(fills) if fills else df
        types = frame.types | {n: v.type for n, (_, v) in kinds.items()}
        return Frame(df, types, frame.keys, True, frame.known), changed if changed is not None else rest

    def join_keys(self, frame: Frame, nodes: list[t.Node], sides: list[tuple[Value, Value]]) -> tuple[Frame, list[_Key]]:
        """Hidden key columns of the left side, and how the right side's are made.

        null == null holds. Instead of a null-safe comparison a key is two plain columns, its value with a filler and
        whether it is null: grouping by them and joining on them then need one shuffle, not two.
        """
        wanted: dict[tuple, list[Column]] = {}
        rights: list[tuple[tuple, list[Column], bool]] = []
        for node, (a, b) in zip(nodes, sides, strict=True):
            type_ = _meeting(a, b)
            left, right = _matched(a, b)
            filler = _filler(type_)
            key = (node, type_.simpleString())
            wanted[key] = _parts(left, filler)
            rights.append((key, _parts(right, filler), filler is None))
        frame, names = frame.holding(wanted)
        return frame, [_Key(n, fresh("k"), c, safe) for key, cols, safe in rights for n, c in zip(names[key], cols, strict=True)]

    def full_join(self, frame: Frame, keyed: DataFrame, grouped: DataFrame, keys: list[_Key], name: str, type_: T.DataType) -> Frame:
        on = [k.on for k in keys]
        lefts = frame.df.join(grouped, on, "left").withColumn(name, F.coalesce(name, F.array().cast(type_)))
        seen = frame.df.select(*dict.fromkeys(k.left for k in keys)).distinct()
        alone = keyed.join(seen, on, "left_anti")
        others = alone.select(*(F.lit(None).cast(x).alias(n) for n, x in frame.types.items()), F.array(F.col(name)).alias(name))
        return Frame(lefts.select(*others.columns).unionByName(others), frame.types | {name: type_}, frame.keys, True)

    def right_join(self, frame: Frame, c: t.Join, right: Frame, pairs, others) -> Frame:
        """A row per right document, with the variables of the first matching left row or nulls."""
        name, order, number = c.collection, fresh("row"), fresh("doc")
        row = F.struct(*(F.col(n) for n in frame.types))
        if pairs and not others:
            sides = [(self.expr(a, frame.scope), self.expr(b, right.scope)) for a, b in pairs]
            frame, keys = self.join_keys(frame, [a for a, _ in pairs], sides)
            lefts = frame.df.withColumn(order, F.monotonically_increasing_id())
            firsts = lefts.groupBy(*dict.fromkeys(k.left for k in keys)).agg(F.min_by(row, order).alias("__left"))
            df = right.df.select(*(k.made.alias(k.right) for k in keys), name).join(firsts, [k.on for k in keys], "left")
        else:
            lefts = saved(frame.df.withColumn(order, F.monotonically_increasing_id()))
            numbered = saved(right.df.withColumn(number, F.monotonically_increasing_id()))
            on = predicate(self.expr(c.on, frame.scope | right.scope, safe=True, filtering=True))
            df = numbered.join(lefts, on, "left").groupBy(number).agg(F.first(name).alias(name), F.min_by(F.when(F.col(order).isNotNull(), row), order).alias("__left"))
        return Frame(df.select(*(F.col("__left")[n].alias(n) for n in frame.types), name), frame.types | right.types, frame.keys, True)

    def theta_join(self, frame: Frame, c: t.Join, right: Frame) -> Frame:
        """Any condition: rows are numbered, joined and grouped again. The numbers are written, so that a task that runs
        again can't give others."""
        name, number, hit = c.collection, fresh("row"), fresh("hit")
        lefts = saved(frame.df.withColumn(number, F.monotonically_increasing_id()))
        side = right.df.withColumn(hit, F.lit(True))
        on = predicate(self.expr(c.on, frame.scope | right.scope, safe=True, filtering=True))
        joined = lefts.join(side, on, "inner" if c.kind == "INNER" else "left")
        matches = F.transform(F.collect_list(F.when(F.col(hit), F.struct(F.col(name).alias("v")))), lambda s: s["v"])
        df = joined.groupBy(number).agg(*(F.first(n).alias(n) for n in frame.types), matches.alias(name)).drop(number)
        out = Frame(df, frame.types | {name: T.ArrayType(right.types[name])}, frame.keys, True)
        if c.kind != "FULL":
            return out
        alone = right.df.join(frame.df, on, "left_anti")
        others = alone.select(*(F.lit(None).cast(x).alias(n) for n, x in frame.types.items()), F.array(F.col(name)).alias(name))
        return replace(out, df=df.select(*others.columns).unionByName(others))

    def flat_join(self, frame: Frame, c: t.Join, right: Frame) -> Frame:
        on = predicate(self.expr(c.on, frame.scope | right.scope, safe=True, filtering=True))
        how = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}[c.kind]
        return Frame(frame.df.join(right.df, on, how), frame.types | right.types, frame.keys, True)

    # -- subqueries

    def hoisted(self, frame: Frame, e: t.Node) -> tuple[Frame, t.Node]:
        """e with its subqueries replaced by variables that the frame now has."""
        calls = {n.name for n in t.walk(e) if isinstance(n, t.Call)}
        if "DOCUMENT" in calls:
            frame, e = self.documents_hoisted(frame, e)
        if "COLLECTION_COUNT" in calls:
            e = t.rewrite(e, lambda n: self.counted(n) if isinstance(n, t.Call) and n.name == "COLLECTION_COUNT" else None)
        if "VECTOR_INDEX_STATS" in calls:
            e = t.rewrite(e, lambda n: t.Call("FIRST", (t.Sub(t.Query((t.For("__s", n),), returns=t.Var("__s"))),)) if isinstance(n, t.Call) and n.name == "VECTOR_INDEX_STATS" else None)
        if calls & set(TABLE_FUNCTIONS):
            e = t.rewrite(e, lambda n: t.Sub(t.Query((t.For("__r", n),), returns=t.Var("__r"))) if isinstance(n, t.Call) and n.name in TABLE_FUNCTIONS else None)
        if not any(isinstance(n, t.Sub) for n in t.walk(e)):
            return frame, e
        state = [frame]

        def change(n: t.Node) -> t.Node | None:
            if isinstance(n, t.Call) and len(n.args) == 1 and isinstance(n.args[0], t.Sub) and (n.name in OVER_ARRAYS or n.name == "FIRST"):
                state[0], name = self.attach(state[0], n.args[0].query, n.name)
                return t.Var(name)
            if isinstance(n, t.Sub):
                state[0], name = self.attach(state[0], n.query, None)
                return t.Var(name)
            return None

        changed = t.rewrite(e, change)
        return state[0], changed

    def split_correlated(self, frame: Frame, query: t.Query) -> tuple[t.Query, list[tuple[t.Node, t.Node]], list[t.Node]]:
        """The query without the filters that mention the outer scope, which are returned as equalities and others."""
        inner = own_names(query)
        outer = {n: Value(F.lit(None), x) for n, x in frame.types.items() if n not in inner}
        pairs, others, body = [], [], []
        for c in query.body:
            if isinstance(c, t.Filter):
                keep = []
                for part in conjuncts(c.test):
                    if t.free_names(part) & outer.keys():
                        p, o = self.equi([part], outer, {n: None for n in inner})
                        pairs += p
                        others += o
                    else:
                        keep.append(part)
                if keep:
                    body.append(t.Filter(conjunction(keep)))
            else:
                body.append(c)
        return replace(query, body=tuple(body), extra={}), pairs, others

    def correlated(self, frame: Frame, query: t.Query) -> bool:
        names = set(frame.types) - own_names(query)
        return bool((t.free_names(query.body) | t.free_names(query.returns) | t.free_names(query.sort)) & names)

    def inner_rows(self, query: t.Query, keys: list[t.Node]) -> tuple[Frame, t.Node, list[str]]:
        """Body of a subquery, with the values of keys in hidden columns as soon as their variables exist."""
        frame, names, clauses = Frame(self.spark.range(1).select(), {}), [fresh("k") for _ in keys], []
        waiting = dict(zip(names, keys, strict=True))
        made: set[str] = set()
        for c in query.body:
            clauses.append(c)
            made |= own_names(t.Query((c,)))
            ready = [n for n, e in waiting.items() if t.free_names(e) <= made]
            if ready:
                clauses.append(t.Let(tuple((n, waiting.pop(n)) for n in ready)))
                clauses.append(_Keys(tuple(ready)))
        if waiting:
            raise QueryError("a subquery's condition uses an unknown variable")
        plain, after = [], None
        for c in clauses:
            if isinstance(c, _Keys):
                frame, _ = self.body(t.Query(tuple(plain), returns=t.Lit(None)), frame)
                frame, plain = replace(frame, keys=frame.keys + c.names), []
            else:
                plain.append(c)
        tail = t.Query(tuple(plain), query.sort, query.offset, query.limit, query.returns)
        frame, after = self.body(tail, frame)
        query.extra.update(tail.extra)
        return frame, after, names

    def attach(self, frame: Frame, query: t.Query, wrapper: str | None) -> tuple[Frame, str]:
        """A column with a subquery's result: its rows as an array, or wrapper (SUM, LENGTH, FIRST ...) of them."""
        name = fresh("sub")
        if not self.correlated(frame, query):
            if wrapper == "FIRST" and query.limit is None:
                query = replace(query, limit=t.Lit(1), extra={})
            elif wrapper is not None and query.limit is None and query.offset is None:
                query = replace(query, sort=(), extra={})
            inner, returns = self.body(query, Frame(self.spark.range(1).select(), {}))
            inner, value = self.numbered(frame, inner, query, returns, [])
            made = self.gathered(inner, value, wrapper)
            df = inner.df.agg(made.col.alias(name))
            out = frame.df.crossJoin(df)
            return replace(frame, df=out, types=frame.types | {name: made.type}), name
        if (v := self.over_own_array(frame, query)) is not None:
            v = registry.call(wrapper, Context(), [v]) if wrapper else v
            return frame.having(**{name: v}), name
        core, pairs, others = self.split_correlated(frame, query)
        if others or not pairs:
            return self.attach_theta(frame, query, wrapper, name)
        inner, returns, keys = self.inner_rows(core, [b for _, b in pairs])
        if t.free_names(returns) & (set(frame.types) - set(inner.types)):
            return self.attach_theta(frame, query, wrapper, name)
        sides = [(self.expr(a, frame.scope), inner.value(k)) for (a, _), k in zip(pairs, keys, strict=True)]
        frame, joined = self.join_keys(frame, [a for a, _ in pairs], sides)
        parted = inner.df.withColumns({k.right: k.made for k in joined})
        inner = replace(inner, df=parted, types=inner.types | {k.right: parted.schema[k.right].dataType for k in joined})
        by = [k.right for k in joined]
        inner, value = self.numbered(frame, inner, core, returns, by)
        made = self.gathered(inner, value, wrapper)
        grouped = inner.df.groupBy(*by).agg(made.col.alias(name))
        df = frame.df.join(grouped, [k.on for k in joined], "left").drop(*(k.right for k in joined))
        empty = of_nothing("LIST" if wrapper is None else OVER_ARRAYS.get(wrapper, "FIRST"), made.type)
        if empty is not None:
            df = df.withColumn(name, F.coalesce(name, empty))
        return replace(frame, df=df, types=frame.types | {name: made.type}), name

    def numbered(self, frame: Frame, inner: Frame, query: t.Query, returns: t.Node, keys: list[str]) -> tuple[Frame, Value]:
        """The returned value per row, after SORT and LIMIT within each set of keys; `__rank` where there is an order."""
        sort = query.extra.get("sort", query.sort)
        offset, limit = query.extra.get("limits", (query.offset, query.limit))
        inner, returns = self.hoisted(inner, returns)
        value = materialised(self.expr(returns, inner.scope))
        order = []
        for e, rising in sort:
            v = self.expr(e, inner.scope)
            order.append(v.col.asc_nulls_first() if rising else v.col.desc_nulls_last())
        order += self.ties(frame, inner, query, returns) if order else []
        if not order and limit is None and offset is None:
            return inner, value
        if not keys and (limit is not None or offset is not None):
            df = inner.df.orderBy(*order) if order else inner.df
            df = df.offset(self.whole(offset)) if offset is not None else df
            df = df.limit(self.whole(limit)) if limit is not None else df
            inner = replace(inner, df=df)
            if not order:
                return inner, value
            return inner.having(__rank=Value(F.row_number().over(Window.orderBy(*order)), LONG)), value
        if not keys:
            return inner.having(__rank=Value(F.row_number().over(Window.orderBy(*order)).cast("long"), LONG)), value
        window = Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))
        inner = inner.having(__rank=Value(F.row_number().over(window).cast("long"), LONG))
        first = 0 if offset is None else self.whole(offset)
        if first:
            inner = inner.where(F.col("__rank") > first)
        if limit is not None:
            inner = inner.where(F.col("__rank") <= first + self.whole(limit))
        return inner, value

    def ties(self, frame: Frame, inner: Frame, query: t.Query, returns: t.Node) -> list[Column]:
        """What rows follow that SORT leaves equal: the documents' `_key`, then what RETURN reads of them, so that the
        result doesn't hang on how a table's rows lie in files and tasks. Elements of arrays keep their places."""
        loops = [c for c in query.body if isinstance(c, (t.For, t.Traverse, t.ShortestPath))]
        tables = [c.var for c in loops if isinstance(c, t.For) and self.is_table(c.source, frame)]
        scope = inner.scope
        read = [t.Field(t.Var(n), "_key") for n in tables if n in scope and scope[n].is_object]
        if len(tables) == len(loops):
            made = own_names(query) | (scope.keys() - frame.types.keys())
            read += [e for e in _reads(returns) if t.free_names(e) <= made & scope.keys()]
        values = [self.expr(e, scope, safe=True) for e in dict.fromkeys(read)]
        return [v.col.asc_nulls_first() for v in values if _orderable(v.type)]

    @staticmethod
    def gathered(inner: Frame, value: Value, wrapper: str | None) -> Value:
        """The wrapper's aggregate of the rows' values, or their array, in rank order where rows are ranked."""
        ranked = "__rank" in inner.types
        if wrapper == "FIRST":
            return Value(F.min_by(value.col, F.col("__rank")) if ranked else F.first(value.col), value.type)
        if wrapper is not None:
            kind = OVER_ARRAYS[wrapper]
            return aggregate(kind, None if kind == "ROWS" else value)
        if not ranked:
            return aggregate("LIST", value)
        pairs = F.array_sort(F.collect_list(F.struct("__rank", F.struct(value.col.alias("v")).alias("s"))), lambda x, y: (x["__rank"] - y["__rank"]).cast("int"))
        return Value(F.transform(pairs, lambda p: p["s"]["v"]), T.ArrayType(value.type))

    def attach_theta(self, frame: Frame, query: t.Query, wrapper: str | None, name: str) -> tuple[Frame, str]:
        """Any correlation: the outer rows are numbered, the subquery runs over both scopes, and its rows are grouped."""
        number, hit = fresh("row"), fresh("hit")
        first, *more = query.body
        if not (isinstance(first, t.For) and self.is_table(first.source, frame)) or not all(isinstance(c, (t.Filter, t.Let)) for c in more):
            return self.attach_any(frame, query, wrapper, name)
        outer = replace(frame, df=saved(frame.df.withColumn(number, F.monotonically_increasing_id())))
        side = document(self.catalog.table(first.source.name), first.var)
        scope, tests = frame.scope | side.scope, []
        for c in more:
            if isinstance(c, t.Let):
                for n, e in c.items:
                    scope[n] = self.expr(e, scope, safe=True)
            else:
                tests.append(predicate(self.expr(c.test, scope, safe=True, filtering=True)))
        on = F.lit(True)
        for x in tests:
            on = on & x
        joined = outer.df.join(side.df.withColumn(hit, F.lit(True)), on, "left")
        value = materialised(self.expr(query.returns, scope))
        order = [(self.expr(e, scope).col, rising) for e, rising in query.sort]
        if order or query.limit is not None:
            keys = [c.asc_nulls_first() if rising else c.desc_nulls_last() for c, rising in order] or [F.lit(1)]
            joined = joined.withColumn("__rank", F.row_number().over(Window.partitionBy(number).orderBy(*keys)))
            low = 0 if query.offset is None else self.whole(query.offset)
            high = None if query.limit is None else low + self.whole(query.limit)
            inside = (F.col("__rank") > low) & (F.lit(True) if high is None else F.col("__rank") <= high)
            joined = joined.withColumn(hit, F.when(inside, F.col(hit)))
        kind = "LIST" if wrapper is None else OVER_ARRAYS.get(wrapper, "FIRST")
        if kind == "ROWS":
            made = Value(F.count(hit), LONG)
        elif kind == "LIST":
            kept = F.collect_list(F.when(F.col(hit), F.struct(value.col.alias("v"))))
            made = Value(F.transform(kept, lambda s: s["v"]), T.ArrayType(value.type))
        elif kind == "FIRST":
            made = Value(F.first(F.when(F.col(hit), value.col), ignorenulls=True), value.type)
        else:
            made = aggregate(kind, Value(F.when(F.col(hit), value.col), value.type))
        df = joined.groupBy(number).agg(*(F.first(n).alias(n) for n in frame.types), made.col.alias(name)).drop(number)
        return replace(frame, df=df, types=frame.types | {name: made.type}), name

    def attach_any(self, frame: Frame, query: t.Query, wrapper: str | None, name: str) -> tuple[Frame, str]:
        """Any subquery: its clauses run over the numbered outer rows, whose number is a key that groupings keep apart."""
        number = fresh("row")
        outer = saved(frame.df.withColumn(number, F.monotonically_increasing_id()))
        start = Frame(outer, frame.types | {number: LONG}, (*frame.keys, number), True, frame.known)
        query = replace(query, extra={})
        inner, returns = self.body(query, start)
        inner, value = self.numbered(frame, inner, query, returns, [number])
        made = self.gathered(inner, value, wrapper)
        grouped = inner.df.groupBy(number).agg(made.col.alias(name))
        df = outer.join(grouped, number, "left").drop(number)
        empty = of_nothing("LIST" if wrapper is None else OVER_ARRAYS.get(wrapper, "FIRST"), made.type)
        df = df.withColumn(name, F.coalesce(name, empty)) if empty is not None else df
        return replace(frame, df=df, types=frame.types | {name: made.type}), name

    def over_own_array(self, frame: Frame, query: t.Query) -> Value | None:
        """FOR x IN outer.array [FILTER ..] [LIMIT n] RETURN e: higher-order functions on the array, no rows at all."""
        if query.sort or not query.body or not isinstance(query.body[0], t.For):
            return None
        first, *more = query.body
        if self.is_table(first.source, frame) or not all(isinstance(c, t.Filter) for c in more):
            return None
        v = self.expr(first.source, frame.scope)
        if not v.is_array:
            return None
        for c in more:
            v = self.kept(v, first.var, c.test, frame.scope)
        if query.limit is not None:
            low = 0 if query.offset is None else self.whole(query.offset)
            v = Value(F.slice(v.col, low + 1, self.whole(query.limit)), v.type)
        one = self.expr(query.returns, frame.scope | {first.var: Value(F.lit(None).cast(v.element), v.element)})
        body = lambda x: materialised(self.expr(query.returns, frame.scope | {first.var: Value(x, v.element)})).col
        return Value(F.transform(v.col, body), T.ArrayType(materialised(one).type))

    def kept(self, v: Value, name: str, test: t.Node, scope: dict[str, Value]) -> Value:
        """The elements of an array for which a condition holds."""
        holds = lambda x: F.coalesce(predicate(self.expr(test, scope | {name: Value(x, v.element)}, safe=True)), F.lit(False))
        return Value(F.filter(v.col, holds), v.type)

    def semi_join(self, frame: Frame, test: t.Node) -> Frame | None:
        """LENGTH((FOR ..)) > 0, == 0 and x [NOT] IN (FOR ..) as semi and anti joins."""
        if not isinstance(test, t.Binary):
            return None
        sub = key = None
        if test.op in ("IN", "NOT IN") and isinstance(test.right, t.Sub):
            sub, key, anti = test.right.query, test.left, test.op == "NOT IN"
        elif isinstance(test.left, t.Call) and test.left.name in ("LENGTH", "COUNT") and len(test.left.args) == 1 and isinstance(test.left.args[0], t.Sub) and isinstance(test.right, t.Lit):
            sign = (test.op, test.right.value)
            if sign not in ((">", 0), ("!=", 0), (">=", 1), ("==", 0), ("<", 1), ("<=", 0)):
                return None
            sub, anti = test.left.args[0].query, sign in (("==", 0), ("<", 1), ("<=", 0))
        if sub is None or sub.limit is not None or any(isinstance(n, t.Sub) for n in t.walk(key)):
            return None
        core, pairs, others = self.split_correlated(frame, sub)
        if key is not None:
            pairs = [*pairs, (key, core.returns)]
        outer = set(frame.types) - own_names(sub)
        if others or not pairs or any(t.free_names(b) & outer for _, b in pairs) or any(isinstance(c, t.Collect) for c in core.body):
            return None
        inner, _, keys = self.inner_rows(core, [b for _, b in pairs])
        sides = [(self.expr(a, frame.scope), inner.value(k)) for (a, _), k in zip(pairs, keys, strict=True)]
        right = inner.df.select(*(_matched(a, b)[1].alias(k) for (a, b), k in zip(sides, keys, strict=True)))
        on = [_matched(a, b)[0].eqNullSafe(right[k]) for (a, b), k in zip(sides, keys, strict=True)]
        return replace(frame, df=frame.df.join(right, on, "left_anti" if anti else "left_semi"))

    # -- windows

    def with_windows(self, frame: Frame, e: t.Node, sort: list[Column]) -> tuple[Frame, t.Node]:
        """e with its OVER calls replaced by variables.

        Partition expressions become hidden columns and all windows one projection, so that windows over the same
        partition share a shuffle, and those of the same order a sort.
        """
        calls = list(dict.fromkeys(n for n in t.walk(e) if isinstance(n, t.Over)))
        if not calls:
            return frame, e
        values = {p: self.expr(p, frame.scope) for o in calls for p in o.partition}
        frame, columns = frame.holding({(p, v.type.simpleString()): [v.col] for p, v in values.items()})
        by = {p: F.col(columns[p, v.type.simpleString()][0]) for p, v in values.items()}
        names = {o: fresh("win") for o in calls}
        frame = frame.having(**{names[o]: self.window(frame, o, sort, [by[p] for p in o.partition]) for o in calls})
        return frame, t.rewrite(e, lambda n: t.Var(names[n]) if isinstance(n, t.Over) else None)

    def window(self, frame: Frame, o: t.Over, sort: list[Column], by: list[Column]) -> Value:
        scope, f = frame.scope, o.call.name
        order = [(v.asc_nulls_first() if up else v.desc_nulls_last()) for v, up in ((self.expr(e, scope).col, up) for e, up in o.order)]
        base = Window.partitionBy(*by)
        rows = base.orderBy(*(order or sort or [F.monotonically_increasing_id()]))
        running, whole = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        args = [self.expr(a, scope) for a in o.call.args]
        ranks = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}
        if f in ranks:
            return Value(ranks[f]().over(rows).cast("long"), LONG)
        if f in ("LAG", "LEAD"):
            step = 1 if len(args) < 2 else int(args[1].literal)
            type_ = args[0].type if len(args) < 3 else common([args[0].type, args[2].type])
            moved = (F.lag if f == "LAG" else F.lead)(conform(args[0], type_), step)
            if len(args) < 3:
                return Value(moved.over(rows), type_)
            number = F.row_number().over(rows)
            size = F.count(F.lit(1)).over(base)
            outside = number <= step if f == "LAG" else number > size - step
            return Value(F.when(outside, conform(args[2], type_)).otherwise(moved.over(rows)), type_)
        if f in ("FIRST_VALUE", "LAST_VALUE"):
            return Value((F.first if f == "FIRST_VALUE" else F.last)(args[0].col).over(whole), args[0].type)
        if f == "COUNT":
            return Value(F.count(args[0].col).over(running) if args else F.lit(0).cast("long"), LONG)
        if f in ("MIN", "MAX"):
            return Value((F.min if f == "MIN" else F.max)(args[0].col).over(running), args[0].type)
        if f in ("SUM", "AVG"):
            x = args[0].col.cast("double") if args[0].is_number else F.lit(None).cast("double")
            return Value(F.coalesce(F.sum(x).over(running), F.lit(0.0)) if f == "SUM" else F.avg(x).over(running), DOUBLE)
        raise QueryError(f"no window function {f}")

    # -- expressions

    def expr(self, e: t.Node, scope: dict[str, Value], safe: bool = False, filtering: bool = False) -> Value:
        """safe: what fails is null; filtering: the value only decides whether a row stays."""
        go = lambda x: self.expr(x, scope, safe)
        if isinstance(e, t.Lit):
            return constant(e.value)
        if isinstance(e, t.Var):
            if e.name not in scope:
                raise QueryError(f"unknown variable {e.name}")
            return scope[e.name]
        if isinstance(e, t.Bind):
            if e.name not in self.binds:
                raise QueryError(f"no value for @{e.name}")
            return constant(self.binds[e.name])
        if isinstance(e, t.Field):
            return field_of(go(e.base), e.name)
        if isinstance(e, t.Index):
            return self.index(go(e.base), go(e.key), e.key)
        if isinstance(e, t.Spread):
            return self.spread(go(e.base), e.path)
        if isinstance(e, t.Obj):
            return struct({k: go(v) for k, v in e.items})
        if isinstance(e, t.Arr):
            return array([go(x) for x in e.items])
        if isinstance(e, t.Unary):
            return self.unary(e.op, e.arg, scope, safe)
        if isinstance(e, t.Binary):
            return self.binary(e, scope, safe, filtering)
        if isinstance(e, t.Ternary):
            return either(truthy(go(e.test)), go(e.then), go(e.other))
        if isinstance(e, t.Case):
            return self.case(e, go)
        if isinstance(e, t.Template):
            return Value(F.concat(*(text(go(p), "null") for p in e.parts)) if e.parts else F.lit(""), TEXT)
        if isinstance(e, t.Quantifier):
            a = go(e.array)
            if not a.is_array:
                return constant(e.kind != "ANY")
            inside = lambda x: truthy(self.expr(e.test, scope | {e.var: Value(x, a.element)}, safe))
            found = {"ANY": F.exists, "ALL": F.forall}.get(e.kind)
            return Value(F.coalesce(found(a.col, inside) if found else ~F.exists(a.col, inside), F.lit(e.kind != "ANY")), BOOL)
        if isinstance(e, t.Call):
            return self.call(e, scope, safe)
        if isinstance(e, t.Over):
            raise QueryError("OVER is for RETURN")
        raise QueryError(f"{type(e).__name__} can't stand here")

    def call(self, e: t.Call, scope: dict[str, Value], safe: bool) -> Value:
        if e.name == "COLLECTION_COUNT":
            return constant(self.catalog.table(str(self.expr(e.args[0], scope).literal)).count())
        args = []
        for a in e.args:
            if isinstance(a, t.Lambda):
                args.append(Function(len(a.params), lambda *vs, a=a: self.expr(a.body, scope | dict(zip(a.params, vs, strict=False)), safe)))
            else:
                args.append(self.expr(a, scope, safe))
        return registry.call(e.name, Context(safe), args)

    def index(self, base: Value, key: Value, node: t.Node) -> Value:
        if base.is_array:
            if isinstance(node, t.Lit) and isinstance(node.value, (int, float)) and node.value < 0:
                raise QueryError("array indexes start at 0")
            return Value(F.get(base.col, key.col.cast("int")), base.element)
        if key.is_text and isinstance(base.type, T.StructType):
            names = base.type.fieldNames()
            if key.constant:
                return field_of(base, str(key.literal))
            type_ = common([field_of(base, n).type for n in names])
            out = F.lit(None).cast(type_)
            for n in names:
                out = F.when(key.col == n, conform(field_of(base, n), type_)).otherwise(out)
            return Value(out, type_)
        if isinstance(base.type, T.MapType):
            return Value(F.try_element_at(base.col, text(key)), base.type.valueType)
        return constant(None)

    @staticmethod
    def spread(base: Value, path: tuple[str, ...]) -> Value:
        if not base.is_array:
            return array([])
        if not path:
            return registry.call("FLATTEN", Context(), [base])
        type_ = base.element
        for name in path:
            type_ = field_of(Value(F.lit(None), type_), name).type

        def step(x):
            v = Value(x, base.element)
            for name in path:
                v = field_of(v, name)
            return materialised(v).col

        return Value(F.coalesce(F.transform(base.col, step), F.array().cast(T.ArrayType(TEXT if isinstance(type_, T.NullType) else type_))), T.ArrayType(TEXT if isinstance(type_, T.NullType) else type_))

    @staticmethod
    def case(e: t.Case, go) -> Value:
        subject = None if e.subject is None else go(e.subject)
        branches = [(truthy(go(a)) if subject is None else equal(subject, go(a)), go(b)) for a, b in e.whens]
        other = constant(None) if e.other is None else go(e.other)
        type_ = storable(common_of(*(b for _, b in branches), other))
        out = None
        for test, b in branches:
            out = (F if out is None else out).when(test, conform(b, type_))
        return other if out is None else Value(out.otherwise(conform(other, type_)), type_)

    def unary(self, op: str, arg: t.Node, scope, safe: bool) -> Value:
        v = self.expr(arg, scope, safe)
        if op == "NOT":
            return Value(~truthy(v), BOOL)
        if not (v.is_number or v.is_null):
            raise QueryError(f"{op} needs a number")
        return Value(-v.col.cast("double"), DOUBLE) if op == "-" else Value(F.bitwise_not(v.col.cast("double").cast("long")).cast("double"), DOUBLE)

    def binary(self, e: t.Binary, scope, safe: bool, filtering: bool) -> Value:
        op = e.op
        if op in ("AND", "OR"):
            if filtering:
                a, b = (self._decides(x, scope) for x in (e.left, e.right))
                return Value(a & b if op == "AND" else a | b, BOOL)
            a, b = (truthy(self.expr(x, scope, safe)) for x in (e.left, e.right))
            return Value(a & b if op == "AND" else a | b, BOOL)
        a = self.expr(e.left, scope, safe)
        if op in ("IN", "NOT IN"):
            found = self.member(a, e.right, scope, safe)
            return Value(~found if op == "NOT IN" else found, BOOL)
        b = self.expr(e.right, scope, safe)
        if op == "==":
            if filtering and b.constant and not b.is_null and (b.is_text or b.is_number or b.is_bool) and type(a.type) is type(b.type):
                return Value(a.col == b.col, BOOL)
            return Value(equal(a, b), BOOL)
        if op == "!=":
            return Value(~equal(a, b), BOOL)
        if op in ("<", "<=", ">", ">="):
            return Value(compare(op, a, b, filtering), BOOL)
        if op in ("LIKE", "NOT LIKE"):
            s = F.coalesce(a.col, F.lit("")) if a.is_text else F.lit("")
            p = F.replace(b.col, F.lit("\\"), F.lit("\\\\")) if b.is_text else F.lit("")
            if b.constant and b.is_text:
                p = F.lit(b.literal.replace("\\", "\\\\"))
            return Value(F.call_function("like", s, p) if op == "LIKE" else ~F.call_function("like", s, p), BOOL)
        if op in ("=~", "!~"):
            return self.matches(op, a, b)
        if op == "~=":
            return Value(F.coalesce(F.levenshtein(text(a, ""), text(b, "")) <= 2, F.lit(False)), BOOL)
        if op == "??":
            type_ = storable(common_of(a, b))
            return Value(F.coalesce(conform(a, type_), conform(b, type_)), type_)
        if op == "||":
            return either(truthy(a), a, b)
        if op in ("+", "-", "*", "/", "%"):
            return arithmetic(op, a, b, safe)
        if op == "..":
            low, high = (x.col.cast("double").cast("long") for x in (a, b))
            return Value(arrays.sequence(low, high), T.ArrayType(LONG))
        return bitwise(op, a, b)

    def _decides(self, e: t.Node, scope) -> Column:
        """A filter's part under AND or OR: truth, in the form that reaches the scan."""
        v = self.expr(e, scope, True, True)
        return v.col if v.is_bool else truthy(v)

    def member(self, a: Value, right: t.Node, scope, safe: bool) -> Column:
        b = self.expr(right, scope, safe)
        if b.is_array:
            if isinstance(b.literal, list) and b.literal and None not in b.literal and type(a.type) is type(b.element):
                return F.coalesce(a.col.isin(*b.literal), F.lit(False))
            return F.coalesce(F.exists(b.col, lambda x: equal(Value(x, b.element), a)), F.lit(False))
        if isinstance(b.type, T.StructType):
            return F.coalesce(text(a).isin(*b.type.fieldNames()), F.lit(False)) if b.type.fields else F.lit(False)
        if isinstance(b.type, T.MapType):
            return F.coalesce(F.map_contains_key(b.col, text(a)), F.lit(False))
        return F.lit(False)

    @staticmethod
    def matches(op: str, a: Value, b: Value) -> Value:
        """Unanchored; patterns that are no strings, too long or invalid match nothing, in either form."""
        import re

        if not b.is_text or not (a.is_text or a.is_null):
            return constant(False)
        if b.constant:
            try:
                re.compile(b.literal)
            except re.error:
                return constant(False)
            if len(b.literal) > 1024:
                return constant(False)
        hit = F.coalesce(F.rlike(a.col.cast("string"), b.col), F.lit(False))
        return Value(hit if op == "=~" else ~hit, BOOL)


@dataclass(frozen=True)
class _Key:
    """A join key: the left column's name, the right one's and what it is made of."""

    left: str
    right: str
    made: Column
    safe: bool

    @property
    def on(self) -> Column:
        return F.col(self.left).eqNullSafe(F.col(self.right)) if self.safe else F.col(self.left) == F.col(self.right)


@dataclass(frozen=True)
class _Keys(t.Node):
    names: tuple[str, ...]


def _path(base: t.Node, path) -> t.Node:
    for name in path:
        base = t.Field(base, name)
    return base


def _reads(e: t.Node) -> list[t.Node]:
    """The variables that an expression reads, as single fields where it reads only those."""
    fields = [n for n in t.walk(e) if isinstance(n, t.Field) and isinstance(n.base, t.Var)]
    whole = {n for n in t.free_names(e) if uses(n, e) > sum(f.base.name == n for f in fields)}
    return [f for f in fields if f.base.name not in whole] + [t.Var(n) for n in sorted(whole)]


def _orderable(type_: T.DataType) -> bool:
    """Whether rows can be sorted by values of this type."""
    if isinstance(type_, T.StructType):
        return all(_orderable(f.dataType) for f in type_.fields)
    return _orderable(type_.elementType) if isinstance(type_, T.ArrayType) else not isinstance(type_, (T.MapType, T.VariantType, T.NullType))


def _meeting(a: Value, b: Value) -> T.DataType:
    """The type in which both sides of an equality are compared."""
    return T.TimestampType() if a.is_time or b.is_time else common_of(a, b)


def _matched(a: Value, b: Value) -> tuple[Column, Column]:
    """Both sides of an equality in one type."""
    type_ = _meeting(a, b)
    return (as_time(a), as_time(b)) if isinstance(type_, T.TimestampType) else (conform(a, type_), conform(b, type_))


def _parts(c: Column, filler: Column | None) -> list[Column]:
    return [c] if filler is None else [F.coalesce(c, filler), c.isNull()]


def _filler(type_: T.DataType) -> Column | None:
    """A value to stand for null beside a null flag; none for nested types."""
    if isinstance(type_, T.StringType):
        return F.lit("")
    if isinstance(type_, T.NumericType):
        return F.lit(0).cast(type_)
    if isinstance(type_, T.BooleanType):
        return F.lit(False)
    return F.timestamp_seconds(F.lit(0)) if isinstance(type_, T.TimestampType) else None
