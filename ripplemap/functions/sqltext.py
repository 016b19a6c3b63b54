"""SQL text expressions: statements, INSERTs and the tables they name.

Everything is a Spark expression on one row's text, so a corpus of any size is
scanned in one narrow stage. Known limits: a ``[bracket]`` name with a quote, a comma or
a parenthesis in it; dollar-quoted bodies and ``BEGIN … END`` blocks are split at their
inner semicolons, as are quoted identifiers that contain one; a quote that stands
unpaired in code hides the text up to the next quote.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes are spelled out: the matcher then looks a character up in one table
# instead of asking several ranges in turn.
_NAME_START = ascii_letters + "_"
_NAME_CHARS = ascii_letters + digits + "_$."
_RUN = f"[{_NAME_CHARS}]++"
_SYMBOLS = rf"""[^{_NAME_CHARS} \t\n\x0b\f\r(),"`]++"""

# Group 1+2: a string's own quotes (its text is blanked). Group 3: a quoted
# identifier with what is chained to it. Comments have no group and vanish.
# Possessive quantifiers keep the matcher iterative on long strings.
_QUOTED = r"""(?:"[^"]*+"|`[^`]*+`)"""
_NOISE = (
    r"(?s)(?=['\"`\-#/])(?:(')(?:[^'\\]|\\.)*+(')"
    r"|(" + _QUOTED + r"(?:\.(?:" + _QUOTED + r"|[\w$]++))*+)"
    r"|--[^\n]*+|# [^\n]*+|/\*.*?\*/)"
)
# Blank runs that are not a single space already.
_BLANK_RUN = r"[\t\n\x0b\f\r]\s*+| \s++"
_INSERT = r"(?i)^insert\b"
_WITH = r"(?=[wW])\b(?i:with)\b"
_CTE = r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)([\w$]+)\s*(?:\([^()]*\)\s*)?as\s*\("

# Spellings of names that are brought to the usual one before tokens are read: a name in
# brackets (an index such as x[1] follows a word), blanks around the dots of a name that does
# not start with a digit, and the join word that a SELECT may also have as its modifier.
_UNUSUAL = r"(?=[\[ .sS])(?:\[| \.|\. |\b(?i:straight_join)\b)"
_BRACKETED = r"""(?<![\w$)\]"`])\[([^\[\](),"`]++)\]"""
_SPACED_DOT = r"""((?<![\w$])[A-Za-z_][\w$]*+|""" + _QUOTED + r""") ?\. ?(?=[A-Za-z_"`])"""
_STRAIGHT_JOIN = r"(?i)(?<!\bselect )(?<!\bdistinct )\bstraight_join\b"

# Words that change what the next token is. Words that no comma can follow before
# another of them comes (UNION, VALUES, LIMIT, ON, USING, …) need no mention.
_LIST_WORDS = ("FROM", "JOIN")
_TARGET_WORDS = ("INTO", "UPDATE", "TABLE", "OVERWRITE")
_PASSING_WORDS = ("ONLY", "LATERAL")
# IS DISTINCT FROM and ON DUPLICATE KEY UPDATE name no table.
_CLAUSE_WORDS = (
    "DISTINCT FROM", "KEY UPDATE",
    "SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "SET", "WINDOW", "RETURNING",
)
# Functions whose arguments may hold a FROM.
_FROM_FUNCTIONS = ("EXTRACT", "SUBSTRING", "TRIM", "OVERLAY", "POSITION")
_WORDS = (*_CLAUSE_WORDS, *_LIST_WORDS, *_TARGET_WORDS, *_PASSING_WORDS)


def _any_of(marks: Sequence[str]) -> str:
    """Pattern of any of the words, sorted so that one look at the initial letter rules
    most of them out."""
    spans = ("A-F", "G-L", "M-R", "S-Z")
    parts = [
        f"(?=[{span}{span.lower()}])(?i:"
        + "|".join(m for m in marks if span[0] <= m[0] <= span[-1]) + ")"
        for span in spans
    ]
    return "(?:" + "|".join(parts) + ")"


# A token is a function opening, or one of the words or a punctuation mark together with
# the text up to the next token. That text starts with the table's name when one is due;
# the alias, the condition and the like behind it say nothing about tables. Runs are
# possessive and of one character class, for this is the hottest pattern here.
_CALL_OPENING = "|".join(w + r" ?\(" for w in _FROM_FUNCTIONS)
_MARK = _any_of([w + r" ?\(" for w in _FROM_FUNCTIONS] + [w + r"\b" for w in _WORDS])
_TAIL = (
    r"(?: *+(?!" + _MARK + r")(?:" + _RUN + r"|" + _QUOTED + r"|" + _SYMBOLS + r"))*+"
)
_TOKEN = (
    r"(?i:" + _CALL_OPENING + r")|" + _any_of([w + r"\b" for w in _WORDS]) + _TAIL
    + r"|[(),]" + _TAIL + r"|\S" + _TAIL
)
_TOKEN_MARK = r"^(?:[(),]|(?i:distinct from|key update)|[A-Za-z]++)"
_NAMELIKE = (
    rf"(?:[{_NAME_START}][{_NAME_CHARS}]*+(?:{_QUOTED}[{_NAME_CHARS}]*+)*+"
    rf"|(?:{_QUOTED}[{_NAME_CHARS}]*+)++)"
)
_NAME_IN_TOKEN = r"^(?:[(),]|[A-Za-z]++)\s*+(" + _NAMELIKE + ")"

# What a parenthesis level holds: plain SQL, a table list, or function arguments.
_PLAIN, _TABLE_LIST, _ARGUMENTS = "p", "t", "a"
# Token codes.
_OPEN, _CLOSE, _COMMA, _LIST, _TARGET, _PASS, _CLAUSE, _CALL, _OTHER = range(9)


def bare_sql(sql: Column) -> Column:
    """SQL without comments, with empty strings in place of literals, blanks squeezed."""
    return F.regexp_replace(F.regexp_replace(sql, _NOISE, "$1$2$3 "), _BLANK_RUN, " ")


def statements(sql: Column) -> Column:
    """Non-empty statements of a script, in order."""
    return F.filter(
        F.transform(F.split(bare_sql(sql), ";"), lambda s: F.trim(s)), lambda s: s != ""
    )


def is_insert(statement: Column) -> Column:
    return statement.rlike(_INSERT)


def inserts(stmts: Column) -> Column:
    return F.filter(stmts, is_insert)


def last_insert(stmts: Column) -> Column:
    """The last INSERT of a script, null when there is none."""
    return F.try_element_at(inserts(stmts), F.lit(-1))


def usual_names(statement: Column) -> Column:
    """A statement with bracketed, spaced and straight-joined names in their usual spelling."""
    plain = F.regexp_replace(statement, _BRACKETED, '"$1"')
    plain = F.regexp_replace(plain, _SPACED_DOT, "$1.")
    return F.when(
        statement.rlike(_UNUSUAL), F.regexp_replace(plain, _STRAIGHT_JOIN, "join")
    ).otherwise(statement)


def cte_names(statement: Column) -> Column:
    return F.regexp_extract_all(statement, F.lit(_CTE), F.lit(1))


def _coded(statement: Column) -> Column:
    """Tokens as struct(text, code, named): the mark's role, and whether text follows it."""
    marked = F.transform(
        F.regexp_extract_all(statement, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.struct(
            t.alias("text"), F.upper(F.regexp_extract(t, _TOKEN_MARK, 0)).alias("mark")
        ),
    )

    def code(text: Column, mark: Column) -> Column:
        return (
            F.when(mark == ",", _COMMA)
            .when(mark == "(", _OPEN)
            .when(mark == ")", _CLOSE)
            .when(mark.isin(*_LIST_WORDS), _LIST)
            .when(mark.isin(*_TARGET_WORDS), _TARGET)
            .when(mark.isin(*_CLAUSE_WORDS), _CLAUSE)
            .when(mark.isin(*_PASSING_WORDS), _PASS)
            .when(mark.isin(*_FROM_FUNCTIONS) & text.endswith("("), _CALL)
            .otherwise(_OTHER)
        )

    return F.transform(
        marked,
        lambda t: F.struct(
            t["text"].alias("text"),
            code(t["text"], t["mark"]).alias("code"),
            (F.length(t["text"]) > F.length(t["mark"])).alias("named"),
        ),
    )


def named_tables(statement: Column) -> Column:
    """Tables a statement names (target first), distinct, without its CTE names.

    A fold over the tokens carries the open parenthesis levels (one letter each, the
    innermost last), whether a table name is due, and the tokens that hold one.
    """

    def state(levels, due, found) -> Column:
        return F.struct(levels.alias("levels"), due.alias("due"), found.alias("found"))

    def step(acc: Column, token: Column) -> Column:
        code, levels, due, found = token["code"], acc["levels"], acc["due"], acc["found"]
        no, unnamed = F.lit(False), ~token["named"]
        outer = F.left(levels, F.length(levels) - 1)
        as_plain, as_list = (F.concat(outer, F.lit(x)) for x in (_PLAIN, _TABLE_LIST))
        opened = F.concat(levels, F.when(due, _TABLE_LIST).otherwise(_PLAIN))
        taken = F.when(token["named"], F.concat(found, F.array(token["text"]))).otherwise(found)
        in_list, in_arguments = levels.endswith(_TABLE_LIST), levels.endswith(_ARGUMENTS)
        # ``due`` holds over a mark without text; a text settles it one way or the other.
        return (
            F.when(code == _COMMA, state(
                levels, in_list & unnamed, F.when(in_list, taken).otherwise(found)))
            .when(code == _OPEN, state(
                opened, due & unnamed, F.when(due, taken).otherwise(found)))
            .when(code == _CLOSE, state(
                F.when(F.length(levels) > 1, outer).otherwise(levels), no, found))
            .when(code == _CALL, state(F.concat(levels, F.lit(_ARGUMENTS)), no, found))
            .when((code == _OTHER) | in_arguments, state(levels, no, found))
            .when(code == _LIST, state(as_list, unnamed, taken))
            .when(code == _TARGET, state(as_plain, unnamed, taken))
            .when(code == _CLAUSE, state(as_plain, no, found))
            .otherwise(state(levels, due & unnamed, F.when(due, taken).otherwise(found)))
        )

    start = state(F.lit(_PLAIN), F.lit(False), F.array().cast("array<string>"))
    statement = usual_names(statement)
    found = F.aggregate(_coded(statement), start, step, lambda acc: acc["found"])
    names = F.transform(found, lambda t: F.regexp_extract(t, _NAME_IN_TOKEN, 1))
    named = F.transform(F.filter(names, lambda t: t != ""), lambda t: F.translate(t, '"`', ""))
    ctes = F.when(statement.rlike(_WITH), cte_names(statement)).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_except(F.array_distinct(named), ctes)


def script_tables(sql: Column, every_insert: bool = False) -> Column:
    """Tables named by a script's last INSERT, or by all of its INSERTs."""
    found = inserts(statements(sql))
    picked = found if every_insert else F.slice(found, -1, 1)
    return F.flatten(F.transform(picked, named_tables))
