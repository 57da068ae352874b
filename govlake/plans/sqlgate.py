"""What a user's statement passes before it runs: dialect shims, read-only gate, partition guard.

The gate is a list of what may run, not of what may not: kinds of plan nodes, groups of functions,
tables of the catalog and Parquet files below named roots. All of it is read from the parsed plan with
its subqueries and named queries. The guard reads the optimised plan, where filters stand on the scans
they reach. The only module that reaches Spark's parser through the JVM gateway.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

from govlake.functions.scalars import SQL_FUNCTIONS

#: Plan nodes of queries, by class name.
QUERY_NODES = frozenset(
    "Aggregate Deduplicate DescribeQueryCommand DescribeRelation Distinct Except ExplainCommand Filter Generate GlobalLimit Intersect Join LateralJoin "
    "LocalLimit LocalRelation Offset OneRowRelation Pivot Project ResolvedInlineTable Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint "
    "UnresolvedInlineTable UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableOrView "
    "UnresolvedTableValuedFunction UnresolvedTransposeNode UnresolvedWith Unpivot Window WithWindowDefinition".split()
)
#: Spark's groups of functions that only compute, and functions of other groups that do.
FUNCTION_GROUPS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs table_funcs url_funcs variant_funcs window_funcs".split())
FUNCTIONS = frozenset(("typeof", "uuid", "monotonically_increasing_id", *SQL_FUNCTIONS))
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class Rejected(ValueError):
    """The statement may not run."""


def _outside_quotes(sql: str, change) -> str:
    """Apply ``change`` to the parts of a statement that are neither quoted text nor comments."""
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", sql, flags=re.S)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


def strip_catalog(sql: str, catalogs: tuple[str, ...]) -> str:
    """``catalog.dataset.table`` -> ``dataset.table`` for the named foreign catalogs."""
    if not catalogs:
        return sql
    names = "|".join(map(re.escape, catalogs))
    return _outside_quotes(sql, lambda p: re.sub(rf"\b(?:{names})\.(?=\w+\.\w+)", "", p, flags=re.I))


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens at ``at``, and the position after it."""
    depth, start, out, i, quote = 0, at + 1, [], at, ""
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    raise Rejected("unbalanced parentheses")


def _calls(sql: str, name: str, rewrite) -> str:
    out, at = "", 0
    for m in iter(lambda: re.compile(rf"\b{name}\s*\(", re.I).search(sql, at), None):
        args, end = _arguments(sql, m.end() - 1)
        out += sql[at : m.start()] + rewrite([_calls(a, name, rewrite) for a in args])
        at = end
    return out + sql[at:]


def shim_functions(sql: str) -> str:
    """Names and arguments that Spark spells otherwise."""
    sql = _outside_quotes(sql, lambda p: re.sub(r"\bstarts_with\s*\(", "startswith(", p, flags=re.I))
    sql = _calls(sql, r"regexp_(?:contains|matches)", lambda a: f"({a[0]} RLIKE {a[1]})")

    def dated(a: list[str]) -> str:
        if len(a) == 3 and a[0].strip("'\"").lower() in ("day", "days"):
            return f"datediff({a[2]}, {a[1]})"
        return f"date_diff({a[0].strip(chr(39))}, {a[1]}, {a[2]})" if len(a) == 3 else f"datediff({', '.join(a)})"

    sql = _calls(sql, r"date_diff", dated)

    def replaced(a: list[str]) -> str:
        target = re.sub(r"\\(\d)", r"$\1", a[2])
        if len(a) > 3 and "g" in a[3]:
            return f"regexp_replace ({a[0]}, {a[1]}, {target})"
        first = a[1].strip()
        return f"regexp_replace ({a[0]}, concat('(?s)^(.*?)', {first}), concat('$1', {target}))" if len(a) == 3 and "(" not in first else f"regexp_replace ({', '.join([a[0], a[1], target])})"

    sql = _calls(sql, r"regexp_replace", replaced) if re.search(r"regexp_replace\(", sql, re.I) else sql
    return re.sub(r"\bUSING\s+SAMPLE\s+(\d+)\s+ROWS?\b", r"ORDER BY rand() LIMIT \1", sql, flags=re.I)


def lift_aliases(sql: str) -> str:
    """``SELECT ... AS x FROM ... WHERE ... x ...`` of one level -> the condition stands around the query."""
    m = re.fullmatch(r"\s*SELECT\s+(?P<cols>.*?)\s+FROM\s+(?P<rest>(?:(?!\bWHERE\b).)*?)\s+WHERE\s+(?P<cond>(?:(?!\b(?:GROUP\s+BY|HAVING|UNION)\b).)*?)(?P<tail>\s+(?:ORDER\s+BY|LIMIT)\b.*)?\s*", sql, flags=re.I | re.S)
    if not m or re.search(r"\bSELECT\b|\bGROUP\s+BY\b", m["rest"] + m["cond"], re.I):
        return sql
    aliases = {a.lower() for a in re.findall(r"\bAS\s+([A-Za-z_]\w*)", m["cols"], flags=re.I)}
    clauses = re.split(r"\s+AND\s+(?![^()]*\))", m["cond"], flags=re.I)
    if any(re.search(r"\bBETWEEN\b|\bOR\b", c, re.I) for c in clauses):
        return sql
    uses = lambda c: any(w.lower() in aliases for w in re.findall(r"(?<![.\w])[A-Za-z_]\w*(?![\w(.])", re.sub(r"'[^']*'", "", c)))
    late, early = [c for c in clauses if uses(c)], [c for c in clauses if not uses(c)]
    if not late:
        return sql
    inner = f"SELECT {m['cols']} FROM {m['rest']}" + (f" WHERE {' AND '.join(early)}" if early else "")
    return f"SELECT * FROM ({inner}) WHERE {' AND '.join(late)}{m['tail'] or ''}"


class _Trees:
    """Reads Catalyst's trees through the gateway: the fields of a node, whatever collections hold them."""

    KINDS = {"node": "org.apache.spark.sql.catalyst.trees.TreeNode", "list": "scala.collection.Iterable", "option": "scala.Option"}

    def __init__(self, spark: SparkSession):
        self.gateway, self._kinds = spark.sparkContext._gateway, {}

    def name(self, x: JavaObject) -> str:
        return x.getClass().getName().rpartition(".")[2].rstrip("$")

    def is_plan(self, x: JavaObject) -> bool:
        return is_instance_of(self.gateway, x, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")

    def _kind(self, x: JavaObject) -> str:
        name = x.getClass().getName()
        if name not in self._kinds:
            found = next((k for k, c in self.KINDS.items() if is_instance_of(self.gateway, x, c)), "")
            self._kinds[name] = found or ("fields" if name.startswith("scala.Tuple") else "")
        return self._kinds[name]

    def values(self, it: JavaObject) -> Iterator:
        while it.hasNext():
            yield it.next()

    def fields(self, node: JavaObject) -> Iterator[JavaObject]:
        """Nodes directly below, of plans and of expressions."""
        todo = list(self.values(node.productIterator()))
        while todo:
            x = todo.pop()
            kind = self._kind(x) if isinstance(x, JavaObject) else ""
            if kind == "node":
                yield x
            elif kind:
                todo += self.values(x.productIterator() if kind == "fields" else x.iterator())

    def walk(self, node: JavaObject) -> Iterator[JavaObject]:
        todo = [node]
        while todo:
            node = todo.pop()
            yield node
            todo += self.fields(node)


@dataclass
class Gate:
    """Checks and rewrites statements for one session.

    ``large`` maps large tables to the columns of which one at least must be filtered;
    ``full_scans`` names tables that may be read whole all the same; ``roots`` are the folders
    below which Parquet files may be named by path, besides the tables of the catalog.
    """

    spark: SparkSession
    catalogs: tuple[str, ...] = ()
    large: dict[str, tuple[str, ...]] = field(default_factory=dict)
    full_scans: frozenset[str] = frozenset()
    roots: tuple[str, ...] = ()

    def __post_init__(self):
        self._trees, self._known, self._leaves = _Trees(self.spark), {}, {}

    def rewrite(self, sql: str) -> str:
        return lift_aliases(shim_functions(strip_catalog(sql.strip().rstrip(";"), self.catalogs)))

    def _plan(self, sql: str):
        return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)

    def _function_allowed(self, parts: list[str]) -> bool:
        """Functions of the engine, and built-in ones of the groups that only compute."""
        name = parts[-1].lower()
        if len(parts) > 1 and [p.lower() for p in parts[:-1]] not in (["builtin"], ["system", "builtin"], ["session"], ["system", "session"]):
            return False
        if name not in self._known:
            state, jvm = self.spark._jsparkSession.sessionState(), self.spark.sparkContext._jvm
            info = state.functionRegistry().lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
            self._known[name] = name in FUNCTIONS or info.isDefined() and info.get().getSource() == "built-in" and info.get().getGroup() in FUNCTION_GROUPS
        return self._known[name]

    def _relation_allowed(self, parts: list[str], named: set[str]) -> bool:
        """Named queries, views of the session, tables of the catalog, Parquet files below the roots."""
        if len(parts) == 1:
            return parts[0].lower() in named or "/" not in parts[0]
        if len(parts) == 2 and parts[0].lower() == "parquet" and not self.spark.catalog.databaseExists("parquet"):
            place = lambda p: posixpath.normpath(re.sub(r"^file:/*", "/", p))
            return any(place(parts[1]) == place(r) or place(parts[1]).startswith(place(r).rstrip("/") + "/") for r in self.roots)
        return len(parts) == 2 and self.spark.catalog.databaseExists(parts[0]) or len(parts) == 3 and parts[0] == "spark_catalog"

    def check_read_only(self, sql: str) -> None:
        """One query over the catalog, with functions that only compute."""
        if _outside_quotes(sql.strip().rstrip(";"), lambda p: p.replace(";", "\0")).count("\0"):
            raise Rejected("one statement at a time")
        try:
            plan = self._plan(sql)
        except Exception as error:
            raise Rejected(f"not a statement: {next((x for x in str(error).splitlines() if x.strip()), '')}") from None
        nodes = list(self._trees.walk(plan))
        named = {n.alias().lower() for n in nodes if self._trees.name(n) == "SubqueryAlias"}
        for node in nodes:
            name = self._trees.name(node)
            if self._trees.is_plan(node) and name not in QUERY_NODES:
                raise Rejected(f"only queries may run, not {name}")
            if "UnresolvedIdentifier" in name or name in ("CallMethodViaReflection", "ScriptTransformation"):
                raise Rejected(f"{name} may not be used")
            if name == "UnresolvedFunction":
                parts = list(self._trees.values(node.nameParts().iterator()))
                if not self._function_allowed(parts):
                    raise Rejected(f"the function {'.'.join(parts)} may not be used")
            elif name == "UnresolvedTableValuedFunction":
                parts = list(self._trees.values(node.name().iterator()))
                if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                    raise Rejected(f"the table function {'.'.join(parts)} may not be used")
            elif name in ("UnresolvedRelation", "UnresolvedTableOrView"):
                parts = list(self._trees.values(node.multipartIdentifier().iterator()))
                if not self._relation_allowed(parts, named):
                    raise Rejected(f"{'.'.join(parts)} is no table of the catalog")

    def _signature(self, leaf: JavaObject) -> str:
        """What a leaf of a plan reads, without the numbers of its columns."""
        if self._trees.name(leaf) == "LogicalRelation" and self._trees.name(leaf.relation()) == "HadoopFsRelation":
            return leaf.relation().location().rootPaths().mkString(",")
        return re.sub(r"#\d+L?", "", leaf.simpleString(10_000))

    def _table_leaves(self, table: str) -> frozenset[str]:
        if table not in self._leaves:
            plan = self.spark.table(table)._jdf.queryExecution().analyzed()
            self._leaves[table] = frozenset(self._signature(x) for x in self._trees.values(plan.collectLeaves().iterator()))
        return self._leaves[table]

    def _scans(self, plan: JavaObject, conditions: tuple) -> Iterator[tuple[JavaObject, tuple]]:
        """Leaves of the optimised plan, each with the conditions that all its rows must meet."""
        name = self._trees.name(plan)
        if plan.children().isEmpty():
            yield plan, conditions
            return
        if name == "Filter":
            conditions = (*conditions, *self._conjuncts(plan.condition()))
        through = name in ("Filter", "Project")
        for x in self._trees.fields(plan):
            if self._trees.is_plan(x):
                yield from self._scans(x, conditions if through else ())
            else:
                for inner in self._trees.walk(x):
                    if self._trees.is_plan(inner) and not inner.children().isEmpty():
                        yield from self._scans(inner, ())

    def _conjuncts(self, condition: JavaObject) -> Iterator[JavaObject]:
        if self._trees.name(condition) == "And":
            yield from self._conjuncts(condition.left())
            yield from self._conjuncts(condition.right())
        else:
            yield condition

    def _bounds(self, condition: JavaObject, columns: set[str]) -> bool:
        """Does the condition alone bound one of the columns? ``OR`` with others, ``<>`` and ``IS NOT NULL`` do not."""
        names = [self._trees.name(x) for x in self._trees.walk(condition)]
        used = {a.name().lower() for a in self._trees.values(condition.references().iterator())}
        return len(used) == 1 and used <= columns and names[0] != "Not" and "IsNotNull" not in names and "DynamicPruningSubquery" not in names

    def check_partitions(self, df: DataFrame) -> list[str]:
        """Large tables that the statement scans without a filter on any of their partition columns."""
        wanted = [t for t in self.large if t not in self.full_scans and self.spark.catalog.tableExists(t)]
        if not wanted:
            return []
        missing = set()
        for leaf, conditions in self._scans(df._jdf.queryExecution().optimizedPlan(), ()):
            read = self._signature(leaf)
            for table in wanted:
                if read in self._table_leaves(table) and not any(self._bounds(c, {x.lower() for x in self.large[table]}) for c in conditions):
                    missing.add(table)
        return [t for t in wanted if t in missing]

    def run(self, sql: str, strict: bool = True) -> DataFrame:
        """The statement's DataFrame, or ``Rejected``."""
        self.check_read_only(sql)
        text = self.rewrite(sql)
        self.check_read_only(text)
        df = self.spark.sql(text)
        if strict and (missing := self.check_partitions(df)):
            raise Rejected(f"filter {', '.join(missing)} on {' or '.join(sorted({c for m in missing for c in self.large[m]}))}")
        return df
