"""Joins on a spatial predicate, rewritten before analysis to joins on grid cells.

``FROM a JOIN b ON ST_Within(a.geom, b.geom)`` (or a comma join with the predicate in WHERE)
would be a nested loop over all pairs. Here each side of an inner join is exploded to the
cells that its geometry touches, the sides meet on equal cells, and the statement's own
predicate decides. Cells are as large as the polygons are on average (but no smaller than a
radius), so that a polygon has few of them. Where both sides are points within a radius, each
row brings its place on the ellipsoid along, the join itself decides by the places and the
predicate goes from the statement. Columns of cells and places don't show in the result.

A predicate over expressions of one side, or in an outer join, is left as it stands.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial_sql

PREDICATES = {"st_within", "st_contains", "st_intersects", "st_dwithin"}
LEAST_CELL = 0.005  # degrees


def _list(jvm_seq) -> list:
    return [jvm_seq.apply(i) for i in range(jvm_seq.size())]


def kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class Rewriter:
    """Rewrites parsed plans of one session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.n = spark, 0
        self.settled = []  # predicates that a cell join has decided
        self.parse = spark._jsparkSession.sessionState().sqlParser().parsePlan
        self._nodes = spark._jvm.org.apache.spark.sql.catalyst.plans.logical

    def frame(self, plan) -> DataFrame:
        """The rows of a parsed plan."""
        return DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def _with(self, plan, children: list):
        seq = self.spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(self.spark._jvm.java.util.ArrayList(children)).toIndexedSeq()
        return plan.withNewChildren(seq)

    def _fill(self, template, leaves: dict):
        """A template's relations replaced by plans of the same name."""
        if kind(template) == "UnresolvedRelation":
            return leaves[template.multipartIdentifier().apply(0)]
        return self._with(template, [self._fill(c, leaves) for c in _list(template.children())])

    def rewrite(self, plan):
        before = _list(plan.children())
        after = [self.rewrite(c) for c in before]
        if any(a is not b for a, b in zip(after, before, strict=True)):
            plan = self._with(plan, after)
        if kind(plan) == "Filter" and kind(plan.child()) == "Join":
            joined = self._place(plan.child(), self._predicates(plan.condition()))
            if joined is plan.child():
                return plan
            left = self._open(plan.condition())
            return self._nodes.Filter(left, joined) if left is not None else joined
        if kind(plan) == "Join" and plan.condition().isDefined():
            return self._place(plan, self._predicates(plan.condition().get()))
        return plan

    def _open(self, e):
        """What is left of a condition without the conjuncts that are decided; None if nothing is."""
        if any(e.equals(p) for p in self.settled):
            return None
        if kind(e) != "And":
            return e
        rest = [c for c in map(self._open, _list(e.children())) if c is not None]
        return self._with(e, rest) if len(rest) == 2 else rest[0] if rest else None

    def _predicates(self, e) -> list:
        """Spatial predicates among the conjuncts."""
        if kind(e) == "And":
            return [p for c in _list(e.children()) for p in self._predicates(c)]
        return [e] if kind(e) == "UnresolvedFunction" and e.nameParts().apply(0).lower() in PREDICATES else []

    def _names(self, e) -> list[list[str]]:
        own = [_list(e.nameParts())] if kind(e) == "UnresolvedAttribute" else []
        return own + [n for c in _list(e.children()) for n in self._names(c)]

    def _aliases(self, plan) -> set[str]:
        if kind(plan) == "SubqueryAlias":
            return {plan.alias().lower()}
        if kind(plan) == "UnresolvedRelation":
            return {_list(plan.multipartIdentifier())[-1].lower()}
        return {a for c in _list(plan.children()) for a in self._aliases(c)}

    def _belongs(self, e, plan) -> bool:
        """Whether an expression reads columns of this side only, and some."""
        aliases, names = self._aliases(plan), self._names(e)
        bare = {c.lower() for c in self.frame(plan).columns} if any(len(n) == 1 for n in names) else set()
        return bool(names) and all(n[0].lower() in (aliases if len(n) > 1 else bare) for n in names)

    def _place(self, join, predicates: list):
        """The join, or a cell join for the first predicate that compares its sides (or sides further down)."""
        if kind(join) != "Join" or join.joinType().toString() not in ("Inner", "Cross"):
            return join
        left, right = join.left(), join.right()
        for p in predicates:
            a, b, *rest = _list(p.children())
            ends = (a, b) if self._belongs(a, left) and self._belongs(b, right) else (b, a) if self._belongs(b, left) and self._belongs(a, right) else None
            if ends:
                return self._cells(join, p, *ends, rest[0].sql() if rest else "0")
        inside = self._place(left, predicates)
        return join if inside is left else self._with(join, [inside, right])

    def _cells(self, join, predicate, a, b, metres: str):
        sides = [(join.left(), a.sql()), (join.right(), b.sql())]
        shapes = []
        for plan, g in sides:
            row = self.frame(plan).agg(
                F.coalesce(F.min(F.expr(f"int(st_is_point({g}))")), F.lit(1)).alias("points"), F.coalesce(F.avg(F.expr(f"greatest(st_xmax({g}) - st_xmin({g}), st_ymax({g}) - st_ymin({g}))")), F.lit(0.0)).alias("wide")
            ).first()  # two numbers
            shapes.append((bool(row.points), row.wide))
        radius = float(self.spark.sql(f"SELECT double({metres})").first()[0] or 0.0) if metres != "0" else 0.0
        cell = max(LEAST_CELL, radius / 110_000.0, *(w for _, w in shapes))
        columns = max(1, math.floor(360.0 / cell))
        both, k = not (shapes[0][0] or shapes[1][0]), self.n
        self.n += 1
        if both and metres != "0":
            return join
        grown = 0 if shapes[1][0] and not shapes[0][0] else 1  # the other side consists of points, each in its own cell
        near = shapes[0][0] and shapes[1][0] and metres != "0"  # points within a radius
        made = []
        for i, (plan, g) in enumerate(sides):
            name, far = f"cell_{k}_{i}", metres if i == grown else "0"
            spot = f", st_spot(st_x({g}), st_y({g})) AS spot_{k}_{i}" if near else ""
            # A function written in SQL has its place in a projection only, so cells are a column first.
            celled = self._fill(self.parse(f"SELECT *, st_cells({g}, {columns}, double({far})) AS {name}_all{spot} FROM side_"), {"side_": plan})
            made.append(self._fill(self.parse(f"SELECT * FROM side_ LATERAL VIEW explode({name}_all) cells_{k}_{i} AS {name}").child(), {"side_": celled}))
        x, y = f"cell_{k}_0", f"cell_{k}_1"
        # Two polygons can meet in several cells; they count in the first that both have.
        first = f" AND {x}.x = pmod(greatest({x}.lx, {y}.lx), {columns}) AND {x}.y = greatest({x}.ly, {y}.ly)" if both else ""
        hidden = f"{x}, {y}, {x}_all, {y}_all"
        if near:
            p, q = f"spot_{k}_0", f"spot_{k}_1"
            first, hidden = f" AND {spatial_sql.chord(p, q)} <= {radius * radius!r}D AND st_way_m({p}, {q}) <= {radius!r}D", f"{hidden}, {p}, {q}"
            self.settled.append(predicate)
            if join.condition().isDefined():
                left = self._open(join.condition().get())
                join = self._nodes.Join(join.left(), join.right(), join.joinType(), self.spark._jvm.scala.Option.apply(left), join.hint())
        template = self.parse(f"SELECT * EXCEPT ({hidden}) FROM join_ WHERE {x}.x = {y}.x AND {x}.y = {y}.y{first}")
        return self._fill(template, {"join_": self._with(join, made)})


def run(spark: SparkSession, plan) -> DataFrame:
    """The rows of a parsed statement, with spatial joins rewritten."""
    if not spark.catalog.functionExists("st_cells"):
        spatial_sql.register(spark)
    rewriter = Rewriter(spark)
    return rewriter.frame(rewriter.rewrite(plan))
