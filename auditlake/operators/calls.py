"""Call-site table and its join with the signatures of risky functions.

The text is lexed by one pattern (comments, raw strings, strings, char literals), cut
into statements at ``; { }`` and every call head is located in place, so one narrow pass
gives name, receiver, line, statement prefix and arguments. A statement is cut at its brackets
and commas once; sorted by depth and place, each bracket is followed by its own commas and its
partner, which gives the arguments of all calls at any nesting depth.

Known differences from a full parse: a file that a parser would reject still reports;
``name name(`` at the start of a statement counts as a declaration; macros are not expanded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, text
from ..functions.arrays import running, runs
from ..functions.text import MARK, let
from ..session import remembered
from .detect import HIT, hit_rows

# Fixed patterns of the C/C++ lexical grammar.
RAW_STRING = r'\bR"([^\s()\\"]{0,16}+)\([\s\S]*?\)\1"'
# What a match begins with is asked first: at most places none does.
TOKENS = r"""(?=[/R"'])(?:""" + "|".join([
    r"/\*[\s\S]*?\*/", r"//[^\n]*+", RAW_STRING,
    r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"]) + ")"
DIRECTIVE = r"(?dm)^[^\S\n]*+#(?:[^\n\\]++|\\[\s\S])*+"
NOT_CALLS = r"if|else|for|while|switch|do|return|sizeof|typedef|catch|alignof|decltype|defined|case|throw|new|delete"
CHAIN = (r"(?:[)\]]\s*+(?:\.|->)\s*+)?(?:\b[A-Za-z_]\w*+\s*+(?:\.|->|::)\s*+)*+")
LEADS_EXPRESSION = r"\b(?:return|else|do|throw|case|goto|co_return|co_await|co_yield|and|or|not|delete|new)\b"
DECLARATION_PREFIX = r"^\s*+(?:[A-Za-z_]\w*+[\s*&]++)++$"
C_CONSTANT = (r"^[\s(]*+(?:(?:(?:u8|[LuU])?\"[^\"]*+\"\s*+)++|(?:[LuU])?'[^']*+'|[0-9.][\w.]*+)[\s)]*+$")
CPP_STRING = r"^(?:u8|[LuU])?R?\"[^\"]*+\"$"


def lex(code: Column) -> Column:
    """Blank comments and the inside of literals; keep quotes, lines and length. Reserved
    characters of the input are replaced first (``text.unmark``)."""

    def token(m: Column) -> Column:
        inner = lambda start, cut: text.blank(F.substring(m, start, F.length(m) - cut))
        return (F.when(F.startswith(m, F.lit("/")), text.blank(m))
                .when(F.startswith(m, F.lit("R")), F.concat(F.lit('R"'), inner(3, 3), F.lit('"')))
                .otherwise(F.concat(F.substring(m, 1, 1), inner(2, 2), F.substring(m, 1, 1))))

    t = text.rewrite_marked(text.unmark(code), TOKENS, token)
    return text.rewrite_marked(t, DIRECTIVE, text.blank, "#")


def head_pattern(names: Sequence[str] | None) -> str:
    which = "|".join(names) if names else rf"(?!(?:{NOT_CALLS})\b)[A-Za-z_]\w*+"
    return rf"(?=[)\]]|\b[A-Za-z_])(?:({CHAIN})\b({which})\s*+\(|\b(?:new|delete)\b)"


def all_args(statement: Column) -> Column:
    """Top-level arguments of every mark of a statement, in order: those of the bracket that opens
    right behind its head, null where none does. A bracket without a partner ends with the statement."""

    def brackets(pieces: Column) -> Column:
        sign = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("(")), 1).when(
            F.startswith(p, F.lit(")")), -1).otherwise(0).cast("bigint"))

        def with_depth(depth: Column) -> Column:
            # a closing bracket belongs to the level it ends
            tokens = F.filter(F.transform(pieces, lambda p, i: F.struct(
                (F.get(depth, i) + F.when(F.startswith(p, F.lit(")")), 1).otherwise(0)).alias("level"), i.alias("at"),
                F.substring(p, 1, 1).alias("token"))), lambda t: t["token"].isin("(", ")", ","))

            def one(run: Column) -> Column:
                upto = F.transform(F.filter(run, lambda t: t["token"] != "("), lambda t: t["at"])
                ends = F.when(F.exists(run, lambda t: t["token"] == ")"), upto).otherwise(F.array_append(upto, F.size(pieces)))
                return F.struct(F.get(run, F.lit(0))["at"].alias("open"), ends.alias("ends"))

            # a run goes from an opening bracket to its partner
            cut = lambda before, t: (t["token"] == "(") | (before["token"] == ")") | (t["level"] != before["level"])
            opened = F.filter(runs(F.sort_array(tokens), cut, lambda r: F.struct(F.get(r, F.lit(0))["token"].alias("token"), one(r).alias("r"))),
                              lambda r: r["token"] == "(")
            return let(F.sort_array(F.transform(opened, lambda r: r["r"])), taken)

        def between(a: Column, b: Column) -> Column:
            whole = F.array_join(F.slice(pieces, a + 1, b - a), "")
            return text.strip(F.replace(F.substring(whole, 2, F.length(whole)), F.lit(MARK), F.lit("")))

        def args(bracket: Column) -> Column:
            ends = bracket["ends"]
            whole = F.transform(ends, lambda e, i: between(F.when(i == 0, bracket["open"]).otherwise(F.get(ends, i - 1)), e))
            return let(whole, lambda w: F.when((F.size(w) == 1) & (F.get(w, F.lit(0)) == ""), F.array().cast("array<string>")).otherwise(w))

        def taken(opened: Column) -> Column:
            number = running(F.transform(sign, lambda x: F.greatest(x, F.lit(0).cast("bigint"))))
            marks = lambda p: text.count_char(p, MARK)
            none = F.lit(None).cast("array<string>")
            return let(number, lambda n: F.flatten(F.transform(pieces, lambda p, i: F.when(F.contains(p, F.lit(MARK)), F.concat(
                F.array_repeat(none, marks(p) - 1),
                F.array(F.when(F.startswith(F.get(pieces, i + 1), F.lit("(")), args(F.get(opened, (F.get(n, i)).cast("int")))))))
                .otherwise(F.array().cast("array<array<string>>")))))

        return let(running(sign), with_depth)

    return let(F.split(statement, r"(?=[(),])", -1), brackets)


def nested(piece: Column) -> Column:
    """Whether the arguments behind this head hold a bracket or go on behind another head."""
    return F.contains(piece, F.lit("(")) & (~F.contains(piece, F.lit(")")) | (
        text.count_char(F.substring_index(piece, ")", 1), "(") > 1))


def flat_args(piece: Column) -> Column:
    """The arguments behind a head that holds no further bracket."""
    inner = F.substring_index(piece, ")", 1)
    return let(F.substring(inner, F.length(F.substring_index(inner, "(", 1)) + 2, F.length(inner)), lambda t: F.when(
        text.strip(t) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(t, ",", -1), text.strip)))


def _statement_calls(statement: Column, needed: Sequence[str] | None) -> Column:
    """Calls of one marked statement. ``needed`` names the functions whose arguments and
    guards are wanted (default all)."""

    def one(pieces: Column, guard: Column, found: Column, piece: Column, i: Column) -> Column:
        """Each pattern runs once: a name bound by ``let`` is not worked out again where it is used."""
        either = F.startswith(piece, F.lit("new")) | F.startswith(piece, F.lit("delete"))
        keyword = F.when(either, F.regexp_extract(piece, r"^(new|delete)\b", 1)).otherwise("")
        head = F.struct(keyword.alias("keyword"), F.substring_index(piece, "(", 1).alias("text"))

        def named(h: Column) -> Column:
            own = F.regexp_extract(h["text"], r"(\w+)\s*$", 1)
            return F.struct(F.when(h["keyword"] != "", h["keyword"]).otherwise(own).alias("name"),
                            h["keyword"].alias("keyword"), h["text"].alias("text"))

        return let(head, lambda h: let(named(h), lambda n: call(pieces, guard, found, piece, i, n["name"], n["keyword"], n["text"])))

    def call(pieces: Column, guard: Column, found: Column, piece: Column, i: Column, name: Column, keyword: Column, head_text: Column) -> Column:
        prefix = pieces[0]
        just_before = F.element_at(pieces, i + 1)
        chained = F.contains(head_text, F.lit(".")) | F.contains(head_text, F.lit(">")) | F.contains(head_text, F.lit(":"))
        chain = F.when((keyword == "") & chained, F.regexp_replace(
            F.regexp_extract(head_text, r"(?s)^(.*\W)\w+\s*$", 1), r"\s+", "")).otherwise("")
        wanted = (keyword == "") if needed is None else name.isin([n for n in needed if n in dims.FORMAT_FUNCTIONS])
        none = F.array().cast("array<string>")
        guarded = (guard > 0) & (guard <= i + 1)
        ask_guard = F.lit(True) if needed is None else name.isin(
            [n for n in needed if n in dims.ALLOC_FUNCTIONS])
        declared = (F.when(keyword == "", (i == 0) & F.rlike(prefix, F.lit(DECLARATION_PREFIX))
                           & ~F.rlike(prefix, F.lit(LEADS_EXPRESSION)))
                    .when(keyword == "delete", F.rlike(just_before, F.lit(r"(?:=|\boperator)\s*$")))
                    .otherwise(F.rlike(just_before, F.lit(r"\boperator\s*$"))))
        return F.struct(
            name.alias("function_name"), chain.alias("receiver"),
            F.when(ask_guard, guarded).otherwise(False).alias("guarded"),
            F.contains(piece, F.lit("nothrow")).alias("nothrow"), declared.alias("declared"),
            F.when(wanted, F.when(nested(piece), F.get(found, i)).otherwise(flat_args(piece))).otherwise(none).alias("args"),
            F.when(i == 0, prefix).otherwise(F.lit("")).alias("stmt_prefix"))

    def guard_of(pieces: Column) -> Column:
        """Number of the first piece with an if or else, found once for all calls; 0 for none."""
        first = F.array_position(F.transform(pieces, lambda p: F.rlike(p, F.lit(r"\b(?:if|else)\b"))), F.lit(True))
        if needed is None:
            return first
        asking = [n for n in needed if n in dims.ALLOC_FUNCTIONS]
        held = F.lit(False)
        for n in asking:
            held = held | F.contains(statement, F.lit(n))
        return F.when(held & F.rlike(statement, F.lit(rf"\b(?:{'|'.join(asking)})\b")), first).otherwise(F.lit(0).cast("bigint"))

    def found(pieces: Column) -> Column:
        """Arguments of all marks, where some are nested."""
        def named(t: Column) -> Column:
            out = F.lit(needed is None)
            for n in needed or ():
                if n in dims.FORMAT_FUNCTIONS:
                    out = out | F.contains(t, F.lit(n))
            return out

        return F.when(named(statement) & F.exists(pieces, lambda p: nested(p) & named(p)), all_args(statement))

    return let(F.split(statement, MARK, -1), lambda pieces: let(F.struct(guard_of(pieces).alias("g"), found(pieces).alias("f")), lambda x: F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda piece, i: one(pieces, x["g"], x["f"], piece, i))))


FLAGGED_NAMES = sorted({s.function_name for s in dims.SIGNATURES} - {"new", "delete"})


def marked_calls(names: Sequence[str] | None = tuple(FLAGGED_NAMES)) -> Column:
    """The lexed ``code`` with a mark before each call head."""
    return text.marked(lex(F.col("code")), head_pattern(names))


def _call_array(marked: Column, names: Sequence[str] | None) -> Column:
    """Array of struct(line, c) of all calls in the marked text, in text order."""
    calls = F.flatten(F.transform(
        F.filter(F.split(F.replace(F.replace(marked, F.lit("{"), F.lit(";")), F.lit("}"), F.lit(";")), ";", -1), lambda s: F.contains(s, F.lit(MARK))),
        lambda s: _statement_calls(s, names)))
    return F.zip_with(text.mark_lines(marked), calls, lambda line, c: F.struct(line.alias("line"), c.alias("c")))


@remembered
def _marked(names: tuple[str, ...] | None) -> Column:
    return marked_calls(names)


@remembered
def _array(names: tuple[str, ...] | None) -> Column:
    return _call_array(F.col("_m"), names)


def _calls(files: DataFrame, names: Sequence[str] | None) -> DataFrame:
    marked = files.select("file_path", "language", _marked(names and tuple(names)).alias("_m"))
    return (marked.select("file_path", "language", F.posexplode(_array(names and tuple(names))).alias("seq", "r"))
            .select("file_path", "language", F.col("seq").cast("bigint"), "r.line", "r.c.*"))


def is_member_call(language: Column, receiver: Column) -> Column:
    """Calls a signature does not apply to because the receiver is taken as the name.

    C: any member access. C++: exactly one plain identifier before ``.`` or ``->``."""
    any_member = F.rlike(receiver, F.lit(r"(?:\.|->)$"))
    plain = F.rlike(receiver, F.lit(r"^(?!this\b)\w+(?:\.|->)$"))
    return F.when(receiver == "", False).when(language == "c", any_member).otherwise(plain)


def call_sites(files: DataFrame) -> DataFrame:
    """Every call: file_path, language, seq, line, function_name, receiver, args, ..."""
    return _calls(files, None).where("NOT declared AND function_name NOT IN ('new','delete')")


def _constant_format(language: Column, arg: Column) -> Column:
    return F.when(language == "c", F.rlike(arg, F.lit(C_CONSTANT))).otherwise(
        F.rlike(arg, F.lit(CPP_STRING)))


def _is_risky(language: Column, family: Column, fmt_arg: Column, args: Column, guarded: Column,
              nothrow: Column) -> Column:
    """What a signature's family asks of a call beyond its name."""
    variable = (F.size(args) > fmt_arg) & ~_constant_format(language, F.get(args, fmt_arg))
    return (F.when(family == "format", variable)
            .when((family == "alloc") & (language == "cpp"), ~guarded)
            .when(family == "new", ~nothrow)
            .otherwise(F.lit(True)))


def matched_calls(files: DataFrame, families: Sequence[str] | None = None) -> DataFrame:
    """Call sites joined to the signatures that flag them, with the signature columns."""
    calls = _calls(files, FLAGGED_NAMES).where(
        ~F.col("declared") & ~is_member_call(F.col("language"), F.col("receiver")))
    sig = dims.signature_dim(files.sparkSession)
    if families:
        sig = sig.where(F.col("family").isin(list(families)))
    joined = calls.join(F.broadcast(sig), ["language", "function_name"])
    return joined.where(_is_risky(*[F.col(c) for c in (
        "language", "family", "fmt_arg", "args", "guarded", "nothrow")]))


def flagged_calls(marked: Column, language: Column, dim_base: int) -> Column:
    """``matched_calls`` inside a row, as an array in the shape of the rule hits: the signature
    table is so small that its key lookup is a literal map. ``marked`` is ``marked_calls`` text."""
    index = F.create_map(*[x for j, s in enumerate(dims.SIGNATURES) for x in (
        F.lit(f"{s.language}:{s.function_name}"), F.lit(dim_base + j))])
    family_of: dict[str, str] = {s.function_name: s.family for s in dims.SIGNATURES}
    fmt_of = {s.function_name: s.fmt_arg for s in dims.SIGNATURES if s.fmt_arg >= 0}

    def by_name(name: Column, table: dict, default) -> Column:
        out = F.lit(default)
        for value in sorted(set(table.values())):
            out = F.when(name.isin([k for k, v in table.items() if v == value]), value).otherwise(out)
        return out

    wanted = {k: v for k, v in family_of.items() if v in ("format", "alloc", "new")}

    def risky(c: Column, s: Column) -> Column:
        return _is_risky(language, s["family"], s["fmt_arg"], c["args"], c["guarded"], c["nothrow"])

    def hit(r: Column) -> Column:
        c = r["c"]
        name = c["function_name"]
        asked = F.struct(by_name(name, wanted, "other").alias("family"), by_name(name, fmt_of, 0).alias("fmt_arg"))
        keep = ~c["declared"] & ~is_member_call(language, c["receiver"]) & let(asked, lambda s: risky(c, s))
        return F.struct(r["line"].alias("line"), F.when(keep, F.element_at(index, F.concat(language, F.lit(":"), name))).alias("dim"),
                        F.when(name.isin("new", "delete"), "").otherwise(name).alias("function_name"))

    hits = F.filter(F.transform(_call_array(marked, FLAGGED_NAMES), hit), lambda h: h["dim"].isNotNull())
    return F.when(F.contains(marked, F.lit(MARK)), hits).otherwise(F.array().cast(HIT))


def call_findings(files: DataFrame, dim_base: int = len(dims.RULES)) -> DataFrame:
    """Slim findings in the shape of ``detect.rule_findings``."""
    marked = files.select("file_path", "language", marked_calls().alias("_m"))
    return hit_rows(marked, flagged_calls(F.col("_m"), F.col("language"), dim_base))
