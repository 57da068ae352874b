"""Column functions. All are built from JVM expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def percent(a: ColumnLike, b: ColumnLike, digits: int = 2) -> Column:
    return F.round(safe_div(_c(a).cast("double") * 100.0, b), digits)


def brl(x: ColumnLike) -> Column:
    """Money as ``R$ 1.234,56``; a minus sign stands before the digits."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(_c(x), 2), ",.", ".,"))


def digits_only(x: ColumnLike) -> Column:
    return F.regexp_replace(_c(x), "[^0-9]", "")


def company_root(x: ColumnLike) -> Column:
    """First eight digits of a company id of fourteen."""
    return F.substring(digits_only(x), 1, 8)


def is_company_id(x: ColumnLike) -> Column:
    return _c(x).rlike("^[0-9]{14}$")


def mask_person_id(x: ColumnLike) -> Column:
    """Eleven digits with only the middle six left: ``***XXXXXX**``."""
    return F.concat(F.lit("***"), F.substring(digits_only(x), 4, 6), F.lit("**"))


def masked_middle(x: ColumnLike) -> Column:
    """The six middle digits of a person id, masked or not."""
    return F.substring(_c(x), 4, 6)


#: Upper ends of age bands, fixed values: 0-17, 18-24, 25-34, 35-44, 45-54, 55-64, 65+.
AGE_BANDS = ((17, "0-17"), (24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"))


def age_band(x: ColumnLike) -> Column:
    out = F.when(_c(x).isNull(), F.lit(None).cast("string"))
    for top, name in AGE_BANDS:
        out = out.when(_c(x) <= top, name)
    return out.otherwise("65+")


#: Parts of type names and their letters in compact schemas, tried in this order (fixed values).
TYPE_LETTERS = (("STRING", "V"), ("CHAR", "V"), ("INT", "I"), ("DOUBLE", "D"), ("FLOAT", "D"), ("DATE", "Dt"), ("TIMESTAMP", "Ts"), ("TIME", "Ti"), ("BOOL", "B"), ("DECIMAL", "Dec"), ("NUMERIC", "Dec"))


def type_abbrev(x: ColumnLike) -> Column:
    """Letters for a type name; names without one stay."""
    out, upper = None, F.upper(_c(x))
    for part, letter in TYPE_LETTERS:
        out = F.when(upper.contains(part), letter) if out is None else out.when(upper.contains(part), letter)
    return out.otherwise(_c(x))


def human_size(x: ColumnLike, largest: str = "TB") -> Column:
    """Bytes as B, KB, MB, GB or TB (base 1024), no unit above ``largest``, with one decimal; ties go to the even digit, as in C; null stays null."""
    value = _c(x).cast("double")
    units = ("B", "KB", "MB", "GB", "TB")
    units = units[: units.index(largest) + 1]
    out = None
    for power, unit in enumerate(units):
        here = F.format_string(f"%.1f {unit}", F.bround(value / F.lit(float(1024**power)), 1))
        small = value.isNotNull() if unit == largest else value < float(1024 ** (power + 1))
        out = F.when(small, here) if out is None else out.when(small, here)
    return out


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Cosine similarity of two arrays of numbers; 0 where a norm is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    product = lambda x, y: F.zip_with(_c(x), _c(y), lambda p, q: p.cast("double") * q.cast("double"))
    norms = F.sqrt(total(product(a, a))) * F.sqrt(total(product(b, b)))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(total(product(a, b)), norms))


def value_text(x: ColumnLike, kind: str = "string") -> Column:
    """A value as a result table shows it: null as NULL, bytes by their number, lists in brackets, intervals by months, days and nanoseconds."""
    c = _c(x)
    if kind == "binary":
        shown = F.concat(F.lit("<blob "), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    elif kind.startswith("array<"):
        shown = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: value_text(v, kind[6:-1])), ", "), F.lit("]"))
    elif kind.startswith(("struct", "map")):
        shown = F.to_json(c)
    elif kind.startswith("interval year") or kind == "interval month":
        months = F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)
        shown = F.concat(months.cast("string"), F.lit("mo 0d 0ns"))
    elif kind.startswith("interval"):
        part = lambda p: F.extract(F.lit(p), c).cast("decimal(38,6)")
        nanos = ((part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")) * 1_000_000_000).cast("decimal(38,0)")
        shown = F.concat(F.lit("0mo "), F.extract(F.lit("DAY"), c).cast("string"), F.lit("d "), nanos.cast("string"), F.lit("ns"))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def csv_line(*columns: ColumnLike, separator: str = ",", quoted: bool = False) -> Column:
    """Columns as one line; null is empty. ``quoted`` puts fields that hold a separator, quote or line end in quotes."""
    fields = [F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]
    if quoted:
        need = lambda f: f.contains(separator) | f.contains('"') | f.contains("\n") | f.contains("\r")
        fields = [F.when(need(f), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f) for f in fields]
    return F.concat_ws(separator, *fields)


def quote_text(x: ColumnLike) -> Column:
    """Text for a quoted SQL literal."""
    return F.replace(_c(x), F.lit("'"), F.lit("''"))


def strip_thinking(x: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", "\n"))


#: Columns that identify persons, by name (fixed values); company ids are public.
SENSITIVE = ("cpf", "cnpj_cpf_socio", "cpf_cnpj_contratado", "titulo_eleitoral")


def mask_sensitive(df: DataFrame, columns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Person ids (eleven digits) of the named columns masked; company ids in them stay."""
    some = {c: F.when(F.length(digits_only(c)) == 11, mask_person_id(c)).otherwise(F.col(c)) for c in df.columns if c.lower() in columns}
    return df.withColumns(some) if some else df


#: SQL functions for statements that users write, as native SQL bodies.
SQL_FUNCTIONS = {
    "brl": "brl(x DOUBLE) RETURNS STRING RETURN concat('R$ ', translate(format_number(x, 2), ',.', '.,'))",
    "digits_only": "digits_only(x STRING) RETURNS STRING RETURN regexp_replace(x, '[^0-9]', '')",
    "company_root": "company_root(x STRING) RETURNS STRING RETURN substring(regexp_replace(x, '[^0-9]', ''), 1, 8)",
    "mask_person_id": "mask_person_id(x STRING) RETURNS STRING RETURN concat('***', substring(regexp_replace(x, '[^0-9]', ''), 4, 6), '**')",
}


def register_functions(spark: SparkSession) -> None:
    for body in SQL_FUNCTIONS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
