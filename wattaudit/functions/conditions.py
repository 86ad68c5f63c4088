"""Tariff conditions and formulas: text written as a Python expression → Spark Column.

Only comparisons, boolean and arithmetic operators, ``in`` lists, literals, ``min``/``max``/``abs``/``round`` and the
bill variables are accepted. Text that is not such an expression never holds (prose conditions are skipped), and so does
one whose value cannot be computed for a bill (a voltage test without a voltage).
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.operators.lookups import fits, join_counted, lookup_join
from wattaudit.session import work_dir

# Variables a condition may use, and the column each reads.
VARIABLES = {
    "user.billed_kwh": "billed_kwh",
    "user.billed_demand": "billed_demand",
    "user.billed_rkva": "billed_rkva",
    "user.days_used": "days_used",
    "user.bill_date": "bill_date",
    "delivery_voltage": "delivery_voltage",
}

ALWAYS = "Always"

#: A number that stands alone, and everything that an expression may consist of; a text with more in it is prose.
_NUMBER = r"(?<![\w.])(?:0|[1-9]\d*)(?:\.\d+)?(?![\w.])"
_EXPRESSION = (
    r"\buser\.\w+(?:\.\w+)?|\bdelivery_voltage\b|\bkV\b|\b(?:and|or|not|in|min|max|abs|round|True|False)\b"
    r"|(?<![\w.])(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.])|[()\[\]{},<>=!+\-*/%]"
)

_DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}
_COMPARE = {
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
}


class Unsupported(ValueError):
    """The text is not an expression over the bill variables."""


def default_variables() -> dict[str, Column]:
    return {name: F.col(c) for name, c in VARIABLES.items()}


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    raise Unsupported(ast.dump(node))


class _Compiler:
    """Compiles to (Column, kind), kind being ``number``, ``bool`` or ``date``; SQL null stands for a failed evaluation."""

    def __init__(self, variables: Mapping[str, Column]):
        self.variables = variables

    def compile(self, node: ast.AST) -> tuple[Column, str]:
        if isinstance(node, ast.Constant):
            if isinstance(node.value, bool):
                return F.lit(node.value), "bool"
            if isinstance(node.value, (int, float)):
                return F.lit(float(node.value)), "number"
        elif isinstance(node, (ast.Name, ast.Attribute)):
            return self.variable(node)
        elif isinstance(node, ast.UnaryOp):
            return self.unary(node)
        elif isinstance(node, ast.BinOp):
            return self.arithmetic(node)
        elif isinstance(node, ast.BoolOp):
            return self.boolean(node)
        elif isinstance(node, ast.Compare):
            return self.comparison(node)
        elif isinstance(node, ast.Call):
            return self.call(node)
        raise Unsupported(ast.dump(node))

    def number(self, node: ast.AST) -> Column:
        value, kind = self.compile(node)
        if kind == "date":
            raise Unsupported("a date is not a number")
        return value.cast("double")

    def truth(self, node: ast.AST) -> Column:
        value, kind = self.compile(node)
        if kind == "number":
            return value != 0
        return value if kind == "bool" else F.when(value.isNotNull(), True)

    def variable(self, node: ast.AST) -> tuple[Column, str]:
        name = _dotted(node)
        if name in self.variables:
            if name.endswith("bill_date"):
                return self.variables[name], "date"
            return self.variables[name].cast("double"), "number"
        base, _, part = name.rpartition(".")
        if base in self.variables and base.endswith("bill_date") and part in _DATE_PARTS:
            return _DATE_PARTS[part](self.variables[base]).cast("double"), "number"
        raise Unsupported(name)

    def unary(self, node: ast.UnaryOp) -> tuple[Column, str]:
        if isinstance(node.op, ast.Not):
            return ~self.truth(node.operand), "bool"
        if isinstance(node.op, ast.USub):
            return -self.number(node.operand), "number"
        if isinstance(node.op, ast.UAdd):
            return self.number(node.operand), "number"
        raise Unsupported(ast.dump(node.op))

    def arithmetic(self, node: ast.BinOp) -> tuple[Column, str]:
        left, right = self.number(node.left), self.number(node.right)
        if isinstance(node.op, ast.Add):
            value = left + right
        elif isinstance(node.op, ast.Sub):
            value = left - right
        elif isinstance(node.op, ast.Mult):
            value = left * right
        elif isinstance(node.op, ast.Div):
            value = F.try_divide(left, right)
        elif isinstance(node.op, ast.FloorDiv):
            value = F.floor(F.try_divide(left, right)).cast("double")
        elif isinstance(node.op, ast.Mod):
            value = left - F.floor(F.try_divide(left, right)) * right
        else:
            raise Unsupported(ast.dump(node.op))
        return value, "number"

    def boolean(self, node: ast.BoolOp) -> tuple[Column, str]:
        """Left to right: a part that fails makes the whole fail unless an earlier part has decided it."""
        stop = isinstance(node.op, ast.Or)
        parts = [self.truth(v) for v in node.values]
        result = parts[-1]
        for part in reversed(parts[:-1]):
            decided = part if stop else ~part
            result = F.when(part.isNull(), F.lit(None).cast("boolean")).when(decided, F.lit(stop)).otherwise(result)
        return result, "bool"

    def comparison(self, node: ast.Compare) -> tuple[Column, str]:
        left, result = node.left, None
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                    raise Unsupported("'in' needs a list")
                options = [self.number(e) for e in right.elts]
                test = self.number(left).isin(*options) if options else F.lit(False)
                test = ~test if isinstance(op, ast.NotIn) else test
            elif type(op) in _COMPARE:
                test = _COMPARE[type(op)](self.number(left), self.number(right))
            else:
                raise Unsupported(ast.dump(op))
            result = test if result is None else result & test
            left = right
        return result, "bool"

    def call(self, node: ast.Call) -> tuple[Column, str]:
        name = _dotted(node.func)
        if node.keywords or not node.args:
            raise Unsupported(name)
        if name == "round":
            places = 0
            if len(node.args) == 2:
                if not (isinstance(node.args[1], ast.Constant) and isinstance(node.args[1].value, int)):
                    raise Unsupported("round needs literal places")
                places = node.args[1].value
            return F.bround(self.number(node.args[0]), places), "number"
        args = [self.number(a) for a in node.args]
        if name == "abs" and len(args) == 1:
            return F.abs(args[0]), "number"
        if name in ("min", "max") and len(args) > 1:
            known = args[0].isNotNull()
            for a in args[1:]:
                known = known & a.isNotNull()
            return F.when(known, F.least(*args) if name == "min" else F.greatest(*args)), "number"
        raise Unsupported(name)


#: Templates that are compiled into one CASE.
MOST_TEMPLATES = 500


def _parse(text: str) -> ast.AST:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as error:
        raise Unsupported(str(error)) from None


def compile_condition(text: str | None, variables: Mapping[str, Column] | None = None) -> Column:
    """Boolean Column of a condition text, never null; a missing condition is ``Always``."""
    if text is None or text == ALWAYS:
        return F.lit(True)
    compiler = _Compiler(default_variables() if variables is None else variables)
    try:
        return F.coalesce(compiler.truth(_parse(text.replace(" kV", ""))), F.lit(False))
    except Unsupported:
        return F.lit(False)


def compile_formula(text: str | None, variables: Mapping[str, Column] | None = None) -> Column:
    """Double Column of a formula text, null where it has no value; a missing formula is 0."""
    if text is None:
        return F.lit(0.0)
    compiler = _Compiler(default_variables() if variables is None else variables)
    try:
        return compiler.number(_parse(text))
    except Unsupported:
        return F.lit(None).cast("double")


def template_of(text: Column) -> Column:
    """The expression in ``text`` with ``?`` for its numbers; null for prose, which is decided by shape alone.

    Texts that differ only in numbers share a template, so few have to be compiled however many texts there are. The
    places of ``round`` are part of the template.
    """
    shape = F.regexp_replace(text, _EXPRESSION, "")
    return F.when(F.trim(shape) == "", F.when(text.contains("round"), text).otherwise(F.regexp_replace(text, _NUMBER, "?")))


def numbers_of(text: Column) -> Column:
    """The numbers that ``template_of`` takes out of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), 0), lambda n: n.cast("double"))


def with_templates(versions: DataFrame, *fields: str) -> DataFrame:
    """Versions whose steps also hold ``<field>_template`` and ``<field>_numbers`` of the given text fields.

    This is done once per version, not per bill.
    """

    def extended(step: Column) -> Column:
        for f in fields:
            step = step.withField(f"{f}_template", template_of(step[f])).withField(f"{f}_numbers", numbers_of(step[f]))
        return step

    return versions.withColumn("steps", F.transform("steps", extended))


def template_blocks(versions: DataFrame, key: list[str], *fields: str, most: int | None = None) -> tuple[DataFrame, list[dict[str, list[str]]]]:
    """Versions from ``with_templates`` with ``template_block``, and the distinct templates of each field by block.

    Up to ``most`` templates (default MOST_TEMPLATES) make one block. Beyond that versions are dealt to blocks by a hash of their ``key``, so that a block
    has about half as many; only one block's templates are read at a time, and no CASE has a branch for all.
    """
    most = MOST_TEMPLATES if most is None else most
    found = versions.select(F.xxhash64(*key).alias("h"), F.explode("steps").alias("s"))
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"s.{f}_template").alias("t")) for f in fields]))
    found = found.select("h", named.alias("n")).select("h", "n.*").where("t is not null").distinct()
    n = found.select("field", "t").distinct().count()
    blocks = 1 if n <= most else -(-2 * n // most)
    number = F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")
    known = []
    for block in range(blocks):
        rows = found.where(F.pmod("h", F.lit(blocks)) == block).select("field", "t").distinct().collect()
        known.append({f: sorted(r.t for r in rows if r.field == f) for f in fields})
    return versions.withColumn("template_block", number), known


def by_block(rows: DataFrame, block: Column, known: list[dict[str, list[str]]], finish: Callable[[DataFrame, dict[str, list[str]]], DataFrame]) -> DataFrame:
    """``finish(rows, templates)`` of all rows: at once if there is one block, else block by block over rows that are written once."""
    if len(known) == 1:
        return finish(rows, known[0])
    spark, path = rows.sparkSession, work_dir(rows.sparkSession, "template-blocks")
    staged = rows.withColumn("_block", F.coalesce(block, F.lit(0)))
    staged.write.partitionBy("_block").parquet(f"{path}/rows")
    staged = spark.read.schema(staged.schema).parquet(f"{path}/rows")
    result = None
    for number, templates in enumerate(known):
        result = finish(staged.where(F.col("_block") == number).drop("_block"), templates)
        result.write.mode("append").parquet(f"{path}/result")
    return spark.read.schema(result.schema).parquet(f"{path}/result")


def _filled(template: str, numbers: Column, variables: Mapping[str, Column] | None) -> tuple[str, dict[str, Column]]:
    """A template with names for its numbers, and the variables with those names."""
    parts = template.split("?")
    text = parts[0] + "".join(f"_n{i}{part}" for i, part in enumerate(parts[1:]))
    named = {f"_n{i}": F.get(numbers, F.lit(i)) for i in range(len(parts) - 1)}
    return text, {**(default_variables() if variables is None else variables), **named}


def case_of(template: Column, known: list[str], compiled: Callable[[str], Column], default: Column) -> Column:
    """``CASE template WHEN <t> THEN <compiled t> … ELSE default``"""
    result = None
    for t in known:
        branch = template == F.lit(t)
        result = F.when(branch, compiled(t)) if result is None else result.when(branch, compiled(t))
    return default if result is None else result.otherwise(default)


def condition_holds(
    condition: Column, template: Column, numbers: Column, known: list[str], variables: Mapping[str, Column] | None = None
) -> Column:
    """Whether a condition holds, by its template (one of ``known``; null for prose) and numbers."""
    always = condition.isNull() | (condition == ALWAYS)
    return always | case_of(template, known, lambda t: compile_condition(*_filled(t, numbers, variables)), F.lit(False))


def formula_value(
    formula: Column, template: Column, numbers: Column, known: list[str], variables: Mapping[str, Column] | None = None
) -> Column:
    """Value of a formula by its template and numbers: 0 without a formula, null for prose."""
    none = F.lit(None).cast("double")
    value = case_of(template, known, lambda t: compile_formula(*_filled(t, numbers, variables)), none)
    return F.when(formula.isNull(), F.lit(0.0)).otherwise(value)


def with_condition(steps: DataFrame, condition: str = "condition", out: str = "holds", most: int | None = None) -> DataFrame:
    """Add whether the condition of each row holds; the distinct templates are compiled on the driver, MOST_TEMPLATES at a time.

    Templates and numbers are read from the distinct texts, which are written once, and looked up by the rows.
    """
    most = MOST_TEMPLATES if most is None else most
    text, path = F.col(condition), work_dir(steps.sparkSession, "condition-texts")
    asked = steps.where(text.isNotNull()).groupBy(text.alias("_text")).agg(F.count(F.lit(1)).alias("_rows"))
    asked = asked.withColumns({"_template": template_of(F.col("_text")), "_numbers": numbers_of(F.col("_text"))})
    asked.write.parquet(path)
    texts = steps.sparkSession.read.schema(asked.schema).parquet(path)
    found = texts.select(F.col("_template").alias("t")).where(F.col("t").isNotNull()).distinct()
    blocks = max(1, -(-found.count() // most))
    number = F.pmod(F.xxhash64("_template"), F.lit(blocks)).cast("int")
    known = [{"t": sorted(r.t for r in found.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect())} for b in range(blocks)]
    keyed = steps.withColumn("_text", text)
    read = lookup_join(keyed, texts.drop("_rows"), ["_text"]) if fits(texts) else join_counted(keyed, texts, ["_text"], "_rows")

    def finish(rows: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
        holds = condition_holds(text, F.col("_template"), F.col("_numbers"), templates["t"])
        return rows.withColumn(out, holds).drop("_text", "_template", "_numbers")

    return by_block(read, number, known, finish)
