"""Raw sensor logs: one ``{'ts': [{'key': value}, ...]}`` literal per line."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalars import to_number

_SHAPE = "map<string,array<map<string,string>>>"
_EMPTY = r"^\s*(\{\s*\}\s*)?$"


def read_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines, with the file they come from."""
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


#: A literal falls into quoted strings, signed numbers, marks and runs of anything else; only white space is between them.
_TOKENS = (
    r"""('[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
    r"""|[+-]\s++(?=[0-9.])[^\s'"{}\[\]():,]++|[^\s'"{}\[\]():,]++|\S)"""
)
#: The parts of a quoted string that holds escapes.
_PARTS = r"(\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[0-7]{1,3}|\\.|[^\\]++)"
_WORDS = {"None": "null", "True": "true", "False": "false", "(": "[", ")": "]"}
_BASES = {"x": 16, "o": 8, "b": 2}


def _decimal(digits: Column, base: int) -> Column:
    """Digits of another base in base 10; beyond 12 digits as a double."""
    long = F.aggregate(F.split(digits, ""), F.lit(0.0), lambda x, d: x * base + F.conv(d, base, 10).cast("double"))
    return F.when(F.length(digits) <= 12, F.conv(digits, base, 10)).otherwise(long.cast("string"))


def _number(t: Column) -> Column:
    """A number as JSON spells it: no plus, no underscores, digits on both sides of a point, base 10."""
    out = F.regexp_replace(t, r"^\+\s*|(?<=^-)\s+|(?<=[0-9A-Fa-fxXoObB])_(?=[0-9A-Fa-f])", "")
    based = F.lower(F.regexp_extract(out, "^-?0([xXoObB])[0-9A-Fa-f]+$", 1))
    sign, digits = F.regexp_extract(out, "^-?", 0), F.regexp_extract(out, "^-?0[xXoObB](.*)$", 1)
    for letter, base in _BASES.items():
        out = F.when(based == letter, F.concat(sign, _decimal(digits, base))).otherwise(out)
    out = F.regexp_replace(out, r"^(-?)0+(?=[0-9]+[.eE]|0$)", "$1")
    out = F.regexp_replace(out, r"^(-?)(?=\.[0-9])", "$10")
    return F.regexp_replace(out, r"^(-?[0-9]+)\.(?=$|[eE])", "$1.0")


def _unescaped(t: Column) -> Column:
    """A quoted string with each escape as JSON spells it; a backslash before another character stays."""

    def part(p: Column) -> Column:
        kind = F.substring(p, 2, 1)
        code = F.when(kind.isin("x", "U"), F.conv(F.substring(p, 3, 8), 16, 10)).when(kind.between("0", "7"), F.conv(F.substring(p, 2, 3), 8, 10))
        code = F.when(kind == "'", "39").when(kind == "a", "7").when(kind == "v", "11").otherwise(code).cast("int")
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        short = F.format_string("\\u%04x", code)
        plain = F.when(kind.isin("u", "n", "t", "r", "b", "f", "\\", '"'), p).when(code < 0x10000, short)
        plain = plain.when(code.isNotNull(), F.format_string("\\u%04x\\u%04x", high, low)).otherwise(F.concat(F.lit("\\"), p))
        return F.when(p.startswith("\\"), plain).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PARTS)), part), "")


def _literal(line: Column) -> Column:
    """The literal in ``line`` as JSON spells it, token by token, so that quoted text is never changed.

    Outside of quotes ``None``, ``True`` and ``False``, numbers such as ``+2.0``, ``.5``, ``5.``, ``1_000``
    and ``0x1f``, tuples, and a comma before a closing bracket become JSON; all else is left as it is.
    """
    tokens = F.regexp_extract_all(line, F.lit(_TOKENS))

    def plain(t: Column, i: Column) -> Column:
        first = F.substring(t, 1, 1)
        quoted = first.isin("'", '"') & (F.length(t) > 1)
        named = F.create_map(*[F.lit(x) for pair in _WORDS.items() for x in pair])
        next_ = F.get(tokens, i + 1)
        return (
            F.when(quoted, F.when(t.contains("\\"), _unescaped(t)).otherwise(t))
            .when(first.between("0", "9") | (first.isin("+", "-", ".") & (F.length(t) > 1)), _number(t))
            .when((t == ",") & next_.isin("]", "}", ")"), "")
            .otherwise(F.coalesce(named[t], t))
        )

    return F.array_join(F.transform(tokens, plain), " ")


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``ts`` and ``items`` to the lines; blank and ``{}`` lines are skipped.

    The first key of a line is its timestamp. Both are NULL for a line that does
    not parse or whose timestamp does not. No condition is put on parsed columns
    here: it would be pushed below and parse every line a second time.
    """
    # most lines are JSON but for their quotes; the others are read token by token
    options = {"allowSingleQuotes": "true", "allowUnquotedControlChars": "true"}
    parsed = F.coalesce(F.from_json(line, _SHAPE, options), F.from_json(_literal(F.col(line)), _SHAPE, options))
    out = df.where(~F.regexp_like(F.col(line), F.lit(_EMPTY))).withColumn("__p", parsed)
    ts = F.try_to_timestamp(F.get(F.map_keys("__p"), F.lit(0)))
    items = F.get(F.map_values("__p"), F.lit(0))
    return out.select(
        *df.columns,
        F.when(items.isNotNull(), ts).alias("ts"),
        F.when(ts.isNotNull(), items).alias("items"),
    )


def sensor_rows(
    parsed: DataFrame,
    clean: Callable[[Column], Column],
    mode: str = "PERMISSIVE",
    line: str = "line",
    text: str | None = None,
) -> DataFrame:
    """Long rows (…, ts, channel, value[, text]); the last value of a channel in a line wins.

    ``text`` names a column for the value as it was written, also where it is no number.

    Keys are cleaned first, so two raw names of one channel also count as the
    same. A line is settled inside its own row: nothing is shuffled. Bad lines
    are left out (see ``bad_lines``) or, with FAILFAST, stop the job.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "FAILFAST":
        reason = F.concat(F.lit("bad sensor line: "), F.col(line))
        good = parsed.withColumn("items", F.when(F.col("items").isNull(), F.raise_error(reason)).otherwise(F.col("items")))
    else:
        good = parsed
    entries = F.flatten(F.transform("items", F.map_entries))
    good = good.withColumn(
        "__e", F.transform(entries, lambda e: F.struct(clean(e["key"]).alias("channel"), e["value"].alias("raw")))
    ).withColumn("__names", F.reverse(F.transform("__e", lambda e: e["channel"])))
    last = F.filter(
        "__e",
        lambda e, i: F.array_position(F.col("__names"), e["channel"]) == F.size("__names") - i,
    )
    out = good.withColumn("__r", F.explode(last)).withColumn("channel", F.col("__r.channel")).withColumn("value", to_number(F.col("__r.raw")))
    if text is not None:
        out = out.withColumn(text, F.col("__r.raw"))
    return out.drop("__e", "__names", "__r", "items", line)


def bad_lines(parsed: DataFrame) -> DataFrame:
    """The quarantine: lines ``sensor_rows`` leaves out in PERMISSIVE mode."""
    return parsed.where("items IS NULL").drop("ts", "items")
