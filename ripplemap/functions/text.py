"""Line-wise text expressions. All of them are JVM-side Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variable delimiters, the marker of a dependency line, and the
# number of trailing lines a pipeline definition loses before it is loaded.
VAR_OPEN = "{{"
VAR_CLOSE = "}}"
DEPENDENCY_MARK = "depends"
BREAKING_CHARACTER = "%"
TRAILING_LINES = 3

_LINE = r"[^\n]*+\n|[^\n]++"
_BREAKING_VALUE = r"^(\s*(?:- +)*(?:[\w.-]+ *: +|- +))(%[^\n]*)\n?$"
# Blank characters that a Unicode-aware strip removes from both ends.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines with their line ends kept; a text without any gives no lines."""
    return F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))


def line_count(text: Column) -> Column:
    """Number of pieces ``lines_of`` gives, without building them."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = (text != "") & ~text.endswith("\n")
    return (ends + open_end.cast("int")).cast("int")


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def lint_yml(text: Column, mode: str = "parity") -> Column:
    """Remove what breaks a YAML loader.

    parity: the last three lines go, then each line with a ``%``.
    intended: nothing goes but directive lines; a plain value that starts with ``%``,
    which no loader takes, is quoted.
    """
    if mode == "intended":
        lines = F.filter(lines_of(text), lambda line: ~line.startswith(BREAKING_CHARACTER))
        return F.array_join(F.transform(lines, _quote_value), "")
    return once(text, lambda whole: F.array_join(
        F.filter(
            F.slice(
                lines_of(whole), F.lit(1), F.greatest(line_count(whole) - TRAILING_LINES, F.lit(0))
            ),
            lambda line: ~line.contains(BREAKING_CHARACTER),
        ),
        "",
    ))


def _quote_value(line: Column) -> Column:
    head, value = (F.regexp_extract(line, _BREAKING_VALUE, i) for i in (1, 2))
    quoted = F.concat(head, F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'\n"))
    return F.when(line.rlike(_BREAKING_VALUE), quoted).otherwise(line)


def literal_map(variables: Mapping[str, str]) -> Column:
    """The variable map as a constant; it comes from one file, never from the corpus."""
    pairs = [F.lit(str(x)) for item in sorted(variables.items()) for x in item]
    return F.create_map(*pairs).cast("map<string,string>")


def _first_variable(line: Column) -> Column:
    """Text between the first opening and the next delimiter of either kind or line end."""
    rest = F.substr(line, F.instr(line, VAR_OPEN) + len(VAR_OPEN))
    return F.substring_index(F.substring_index(rest, VAR_OPEN, 1), VAR_CLOSE, 1)


def substitute_lines(text: Column, variables: Mapping[str, str]) -> Column:
    """Replace the first ``{{variable}}`` of each line (reference behaviour).

    A known variable is replaced wherever that exact spelling stands on the line.
    A line whose first variable is unknown is dropped when it names a dependency;
    otherwise it loses all braces, and the variable's text loses its blanks.
    """
    known = literal_map(variables)

    def resolve(c: Column) -> Column:
        line, var, key = c["line"], c["var"], c["key"]
        value = F.try_element_at(known, key)
        spelled = F.concat(F.lit(VAR_OPEN), var, F.lit(VAR_CLOSE))
        bare = F.replace(
            F.replace(line, F.lit(VAR_CLOSE), F.lit("")), F.lit(VAR_OPEN), F.lit("")
        )
        squeezed = F.replace(var, F.lit(" "), F.lit(""))
        return (
            F.when(value.isNotNull(), F.replace(line, spelled, value))
            .when(key.contains(DEPENDENCY_MARK), F.lit(None).cast("string"))
            .otherwise(F.replace(bare, var, squeezed))
        )

    def replaced(line: Column) -> Column:
        # Handed on in structs: Spark cannot pass a text on to a Python function when an
        # inner lambda names an outer lambda's variable.
        cut = F.struct(line.alias("line"), _first_variable(line).alias("var"))
        keyed = once(cut, lambda c: F.struct(
            c["line"].alias("line"), c["var"].alias("var"), strip_blanks(c["var"]).alias("key")
        ))
        return once(keyed, resolve)

    done = F.transform(
        lines_of(text),
        lambda line: F.when(line.contains(VAR_OPEN), replaced(line)).otherwise(line),
    )
    # array_join leaves out the nulls, that is, the dropped lines.
    return F.array_join(done, "")


def substitute_all(text: Column, variables: Mapping[str, str]) -> Column:
    """Intended mode: every known variable everywhere, then the unknown-variable rules."""
    for name, value in sorted(variables.items()):
        pattern = r"\{\{\s*+" + _quote(name) + r"\s*+\}\}"
        text = F.regexp_replace(text, F.lit(pattern), F.lit(_quote_replacement(str(value))))
    return once(text, lambda rest: _where_open(rest, {}))


def _where_open(text: Column, variables: Mapping[str, str]) -> Column:
    """Most texts have no variable at all and are passed on as they are."""
    return F.when(text.contains(VAR_OPEN), substitute_lines(text, variables)).otherwise(text)


def _quote(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def _quote_replacement(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def substitute(text: Column, variables: Mapping[str, str], mode: str = "parity") -> Column:
    if mode == "intended":
        return substitute_all(text, variables)
    return once(text, lambda whole: _where_open(whole, variables))
