"""Exported signatures, one packed row for each declaration.

The masked texts of :mod:`skimdex.operators.lexer` (equal in length to the source, with
everything below a depth blanked) make declarations, members and parameters findable by
pattern: at its own depth a body is ``{____}``. All texts that are returned are cut from
the source by their spans. Steps, all within the row of a file:

1. the depth-0 text is cut at statement heads (``export``, or a word that opens a
   declaration at the start of a statement); each piece, with the same span of the other
   texts, is a declaration with its kind and name;
2. class, interface and enum bodies are cut into members in the depth-1 text: at ``;``,
   at ``,`` (interfaces and enums), after a closed body, or at a line end that does not
   continue;
3. parameter lists are cut at their commas; each becomes ``name: type`` (declared type,
   else a type read from a literal default, else ``any``).

``<`` opens type arguments only if its ``>`` comes before a token that can't stand in a
type (``&&``, ``=``, ``;``, arithmetic ...), so comparisons in defaults split nothing.
Nothing is shuffled or joined up to the declarations; numbering and overloads need one
exchange of the narrow result. Types are the declared ones, with one space where the
source had any white space; a missing return annotation prints ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.functions import paths as P
from skimdex.functions import text as T
from skimdex.operators import lexer as L
from skimdex.operators.lexer import let
from skimdex.operators.tokens import FILE_KEYS
from skimdex.session import materialize

# Fixed values of the reference behaviour.
KIND_RANK = {"function": 1, "class": 2, "interface": 3, "type": 4, "enum": 5}
MAX_CLASS_METHODS = 5
MAX_INTERFACE_PROPS = 8
ANON_FUNCTION = "anonymous"
ANON_CLASS = "AnonymousClass"
MISSING_RETURN = "unknown"   # no checker: an unannotated return type
UNTYPED_PARAM = "any"

# Grammar words used to read declarations.
DECL_MODIFIERS = ["export", "default", "declare", "async", "abstract", "const"]
MEMBER_MODIFIERS = ["public", "private", "protected", "static", "readonly", "async", "abstract", "override", "declare", "accessor"]
PARAM_MODIFIERS = ["public", "private", "protected", "readonly", "override"]
# Words that open a statement which may declare a name exported elsewhere in the file.
LOCAL_STARTS = list(KIND_RANK) + ["abstract", "async", "declare", "const"]

DECL_KEYS = FILE_KEYS + ["pos"]
#: Columns of a file that its symbols keep, if it has them.
CARRIED = ["size_bytes"]
SYMBOL_COLUMNS = ["target_dir", "path", "ord", "kind", "name", "params", "return_type", "docstring"]

# --- patterns over masked text -------------------------------------------------------

def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


LETTER = r"[A-Za-z_$\x{80}-\x{10FFFF}]"
WORD_END = r"(?![\w$]|[^\x00-\x7F])"
IDENT = LETTER + r"[\w$\x{80}-\x{10FFFF}]*+"
NAME_START = r"(?=[\w$\[\"'*#]|[^\x00-\x7F])"
_TYPE_CHARS = r"[\w$\s,.:?()\[\]{}\"'`#@\x{80}-\x{10FFFF}-]++|=>|&(?!&)|\|(?!\|)"
#: Generic arguments nested deeper than this are read as comparisons.
ANGLE_DEPTH = 8


def _angles(chars: str) -> str:
    p = rf"<(?:{chars})*+>"
    for _ in range(ANGLE_DEPTH - 1):
        p = rf"<(?:{chars}|{p})*+>"
    return p


ARGUMENTS = _angles(_TYPE_CHARS)
#: A declaration's own type parameters may have defaults.
PARAMETERS = _angles(_TYPE_CHARS + r"|=(?!=)")

# Before a line end or a brace these go on with what follows; at the start of a line the
# others go on with what stands before.
OPEN_CHARS, OPEN_WORDS = r"[:|&<,(\[?=.]", ["extends", "keyof", "typeof", "new"]
GOES_ON = rf"(?:{OPEN_CHARS}|=>|(?<![\w$]){_any(OPEN_WORDS)})"
LEADING = rf"(?:[|&.?:=>)\]}};,]|(?:extends|is){WORD_END})"
LINE_END = rf"(?=\s)(?<=\S)(?<!{GOES_ON})[^\S\n]*\n(?=\s*(?!{LEADING}|\{{)\S)"
#: A brace that opens a code block, not an object type.
BLOCK = rf"(?=\{{)(?<!{GOES_ON}\s{{0,200}})\{{"

#: The first look back is at two characters, which tells most places that are no heads.
HEAD = (
    rf"(?=[acdefit])(?:(?=export{WORD_END})(?<![\w$.#@])"
    rf"|(?={_any(LOCAL_STARTS)}{WORD_END})(?<=\A|[\n;}}]|\A[^\S\n]|[\s;}}][^\S\n])(?<=(?:\A|[\n;}}])[^\S\n]{{0,400}})(?<!{_any(DECL_MODIFIERS)}\s{{1,100}}))"
)
DECLARATION = (
    rf"^((?:{_any(DECL_MODIFIERS)}\s+)*+)({_any(list(KIND_RANK))}){WORD_END}\s*(?:\*\s*)?"
    rf"(?!(?:extends|implements){WORD_END})({IDENT})?"
)
#: A constant; only on request, for the index does not list them.
CONSTANT = rf"^export\s+(?:declare\s+)?const\s+(?!enum{WORD_END})(?={IDENT}\s*[:=;])"
RETURN = rf"(?s)^\s*:(.*?)(?:{BLOCK}|;|\z)"
ENDS_BY = rf"(?s)^.*?({BLOCK}|;|\z)"
ALIAS = rf"(?s)^(.*?)(?:;|\z|{LINE_END})"
BODY = rf"(?s)^(?:[^{{<]++|{ARGUMENTS}|[^{{])*+\{{"
LIST_NAMES = rf"(?:^|,)\s*(?:type\s+(?!as{WORD_END}))?({IDENT})"

DECORATORS = r"^\s*(?:@[\w$.]+(?:\(_*\))?\s*)*+"
PARAMETER = rf"(?s)(?:[^,<]++|{ARGUMENTS}|[^,])*+(?:,|\z)"
PARAM_PREFIX = DECORATORS + rf"(?:{_any(PARAM_MODIFIERS)}\s+{NAME_START}|{_any(PARAM_MODIFIERS)}\s+(?=\{{))*+(?:\.\.\.\s*)?"
PARAM_TYPE = rf"(?s)^\??\s*:((?:[^=<]++|{ARGUMENTS}|=>|[^=])*+)"
AFTER_BRACE = rf"\}}(?=[^\S\n]*\n\s*(?!{LEADING}|\{{)\S|[^\S\n]*(?!{LEADING}|\{{|\[|\n)\S)"
MEMBER_NAME = rf"\[_*\]|#?{IDENT}|\"_*\"|'_*'|[0-9][\w.]*"
MODIFIERS = rf"((?:{_any(MEMBER_MODIFIERS)}\s+{NAME_START})*+)"
METHOD = rf"(?s)^{MODIFIERS}((?:get|set)\s+(?={IDENT}))?(?:\*\s*)?({MEMBER_NAME})(\s*[?!]?\s*(?:{PARAMETERS}\s*)?\()"
PROPERTY = rf"(?s)^{MODIFIERS}({IDENT}|\"_*\"|'_*')\s*(\??)\s*:"


def _members(ends: str) -> str:
    return rf"(?s)(?:[\w$]++|{ARGUMENTS}|(?!{ends}).)*+(?:{ends}|\z)"


MEMBER = {
    "class": _members(rf";|{AFTER_BRACE}|{LINE_END}"),
    "interface": _members(rf"[;,]|{AFTER_BRACE}|{LINE_END}"),
    "enum": _members(","),
}


# --- spans ---------------------------------------------------------------------------

def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _from(text: Column, start: Column, size: Column | None = None) -> Column:
    """``size`` characters from the 0-based ``start`` on, or all of them."""
    return F.substring(text, start + 1, F.greatest(size, F.lit(0)) if size is not None else F.length(text))


def _matched(text: Column, pattern: str) -> Column:
    """Length of the match of an anchored pattern, 0 if there is none."""
    return F.length(F.regexp_extract(text, pattern, 0))


def _find(text: Column, char: str, start: Column) -> Column:
    """0-based place of the first ``char`` from ``start`` on, or the text's end."""
    at = F.call_function("locate", F.lit(char), text, start + 1)
    return F.when(at > 0, at - 1).otherwise(F.length(text))


#: Sums of this many lengths are taken at a time.
RUN = 64


def starts_of(pieces: Column) -> Column:
    """Where each piece of a text starts. Sums go run by run, so the work does not grow
    with the square of the number of pieces."""
    empty = F.array().cast("array<int>")
    acc = lambda total, out: F.struct(total.alias("total"), out.alias("out"))
    one = lambda s, x: acc(s["total"] + F.length(x), F.concat(s["out"], F.array(s["total"])))

    def run(s: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(pieces, i, RUN), acc(s["total"], empty), one)
        return let(inner, lambda r: acc(r["total"], F.concat(s["out"], r["out"])))

    n = F.size(pieces)
    runs = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(RUN))).otherwise(empty)
    return F.aggregate(runs, acc(F.lit(0), empty), run)["out"]


def clean(text: Column) -> Column:
    """A span of the source: one space for any white space, literals as they are."""
    return L.restored(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def tight(text: Column) -> Column:
    return L.restored(F.regexp_replace(text, r"\s+", ""))


def jsdoc(trivia: Column) -> Column:
    """Text of the JSDoc blocks in a declaration's leading trivia, joined by a
    space (tags and comment stars dropped), cut to 120, blank -> NULL."""
    blocks = F.regexp_extract_all(trivia, F.lit(r"/\*\*([\s\S]*?)\*/"), 1)
    cleaned = F.transform(
        blocks,
        lambda b: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(b, r"(?m)^[ \t]*\*?[ \t]?", ""), r"(?s)(^|\n)\s*@.*$", ""),
            r"^\s+|\s+$",
            "",
        ),
    )
    return T.blank_to_null(T.cut(F.array_join(cleaned, " "), T.DOCSTRING_CHARS))


# --- 3. parameters ---------------------------------------------------------------------

def _bound(body, **values: Column) -> Column:
    """``body`` of a struct of ``values``, each evaluated once: a span that is named in an
    expression more than once, or inside a lambda, would else be cut again each time."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def parameter(b: Column, src: Column) -> Column:
    """``name: type`` of one parameter (masked, source), NULL if it has no name."""
    def named(pre: Column) -> Column:
        return let(_from(b, pre), lambda own: let(F.length(F.regexp_extract(own, r"(?s)^[^:=?]*+", 0)), lambda n: split(pre, n, own)))

    def split(pre: Column, n: Column, own: Column) -> Column:
        rest = _from(own, n)
        return _bound(lambda r: typed(pre, n, r), rest=rest, colon=_matched(rest, r"^\??\s*:"))

    def typed(pre: Column, n: Column, r: Column) -> Column:
        name, colon = tight(_from(src, pre, n)), r["colon"]
        declared = clean(_from(src, pre + n + colon, F.length(F.regexp_extract(r["rest"], PARAM_TYPE, 1))))
        default = F.btrim(F.regexp_replace(F.regexp_extract(r["rest"], r"(?s)^\??\s*=(.*)$", 1), r",\s*$|\s+", " "))
        inferred = lambda d: (
            F.when(d.rlike("^(?:\"_*\"|'_*'|`_*`)$"), F.lit("string"))
            .when(d.rlike(r"^[0-9][0-9A-Za-z_.]*$"), F.lit("number"))
            .when(d.isin("true", "false"), F.lit("boolean"))
            .otherwise(F.lit(UNTYPED_PARAM))
        )
        text = lambda x: F.when(x != "", F.concat(x, F.lit(": "), F.when(colon > 0, declared).otherwise(let(default, inferred))))
        return let(name, text)

    return let(_matched(b, PARAM_PREFIX), named)


def parameters(b: Column, src: Column) -> Column:
    """Text of a parameter list from its masked text, at its own depth, and its source."""
    def of(t: Column) -> Column:
        def one(piece: Column, start: Column) -> Column:
            bare = F.regexp_replace(piece, r",$", "")
            return let(bare, lambda p: let(_from(t["src"], start, F.length(p)), lambda own: parameter(p, own)))

        def all_of(pieces: Column) -> Column:
            return F.array_join(F.filter(F.zip_with(pieces, starts_of(pieces), one), lambda x: x.isNotNull()), ", ")

        return let(_all(t["b"], PARAMETER), all_of)

    return _bound(of, b=b, src=src)


# --- 2. members -------------------------------------------------------------------------

def _class_member(b: Column, deep: Column, src: Column) -> Column:
    """Constructor (grp 0), method that isn't private (grp 1) or NULL."""
    def method(pre: Column) -> Column:
        whole = F.regexp_extract(_from(b, pre), METHOD, 0)
        return let(whole, lambda m: F.when(m != "", found(pre, m)))

    def found(pre: Column, whole: Column) -> Column:
        parts = {k: F.regexp_extract(whole, METHOD, g) for g, k in enumerate(("mods", "accessor", "name", "after"), 1)}
        return _bound(lambda m: F.when(m["accessor"] == "", listed(m)), lp=pre + F.length(whole), **parts)

    def listed(m: Column) -> Column:
        return let(_find(b, ")", m["lp"]), lambda rp: signature(m, m["lp"], rp))

    def signature(m: Column, lp: Column, rp: Column) -> Column:
        # The name ends where the parenthesis, type parameters and blanks before it begin.
        name = tight(_from(src, lp - F.length(m["after"]) - F.length(m["name"]), F.length(m["name"])))
        scope = F.regexp_extract(m["mods"], r"(public|private|protected)", 1)
        return _bound(lambda k: made(lp, rp, k), name=name, scope=scope)

    def made(lp: Column, rp: Column, k: Column) -> Column:
        params = parameters(_from(deep, lp, rp - lp), _from(src, lp, rp - lp))
        tail = _from(b, rp + 1)

        def returned(t: Column) -> Column:
            text = lambda has: clean(_from(src, rp + 1 + has, F.length(F.regexp_extract(t, RETURN, 1))))
            told = lambda has: F.when(has > 0, F.nullif(text(has), F.lit("")))
            return F.coalesce(let(_matched(t, r"^\s*:"), told), F.lit(MISSING_RETURN))

        text = F.concat(F.when(k["scope"] == "", F.lit("public")).otherwise(k["scope"]), F.lit(" "), k["name"], F.lit("("), params, F.lit("): "), let(tail, returned))
        member = lambda grp, t: F.struct(F.lit(grp).alias("grp"), t.alias("text"))
        return F.when(k["name"] == "constructor", member(0, F.concat(F.lit("constructor("), params, F.lit(")")))).when(k["scope"] != "private", member(1, text))

    return let(_matched(b, DECORATORS), method)


def _property(b: Column, src: Column) -> Column:
    """``name[?]: type`` of an interface property, else NULL."""
    def read(pre: Column) -> Column:
        whole = F.regexp_extract(_from(b, pre), PROPERTY, 0)
        return let(whole, lambda m: F.when(m != "", found(pre, m)))

    def found(pre: Column, whole: Column) -> Column:
        parts = {k: F.regexp_extract(whole, PROPERTY, g) for g, k in enumerate(("mods", "name", "optional"), 1)}
        return _bound(lambda m: text(pre, m), start=pre + F.length(whole), **parts)

    def text(pre: Column, m: Column) -> Column:
        name = L.restored(_from(src, pre + F.length(m["mods"]), F.length(m["name"])))
        end = F.length(F.regexp_replace(b, r"[;,]\s*$", ""))
        return F.concat(name, m["optional"], F.lit(": "), clean(_from(src, m["start"], end - m["start"])))

    return let(_matched(b, DECORATORS), read)


def _enum_member(src: Column) -> Column:
    name = F.regexp_extract(src, rf"^\s*(\"[^\"]*\"|'[^']*'|{IDENT})", 1)
    return F.when(name != "", L.restored(name))


def _body_members(kind: str, lb: Column, rb: Column) -> Column:
    """Members of the body between ``lb`` and ``rb``, in order. The body is cut from each
    text once, and a member from the body once, so the work is linear in its length."""
    texts = {"class": ["d2", "src"], "interface": ["src"], "enum": ["src"]}[kind]

    def member(m: Column) -> Column:
        if kind == "class":
            return _class_member(m["d1"], m["d2"], m["src"])
        return _property(m["d1"], m["src"]) if kind == "interface" else _enum_member(m["src"])

    def of(body: Column) -> Column:
        def one(piece: Column, start: Column) -> Column:
            return _bound(member, d1=piece, **{c: _from(body[c], start, F.length(piece)) for c in texts})

        return let(_all(body["d1"], MEMBER[kind]), lambda p: F.filter(F.zip_with(p, starts_of(p), one), lambda x: x.isNotNull()))

    return _bound(of, **{c: _from(F.col(c), lb, rb - lb) for c in ["d1", *texts]})


# --- 1. declarations ---------------------------------------------------------------------

def _opens(d0: Column) -> Column:
    return d0.rlike(DECLARATION) | d0.rlike(r"^export\s")


PIECE_TEXTS = ["d0", "d1", "d2", "src"]


def _small_statements(files: DataFrame, keys: list[str], declares: str, marks: bool) -> DataFrame:
    x = files.select(*keys, "content", L.lexed(F.col("content"), L.is_jsx(F.col("path"))).alias("x"))
    x = x.select(*keys, "content", *[F.col(f"x.{c}").alias(c) for c in PIECE_TEXTS], F.col("x.suspect").alias("suspect"))
    x = x.withColumn("pieces", F.split("d0", HEAD, -1)).withColumn("starts", starts_of(F.col("pieces")))

    def piece(d0: Column, i: Column) -> Column:
        start, n = F.get("starts", i), F.length(d0)
        last = F.get("pieces", i - 1)
        gap = F.coalesce(F.length(last) - F.length(F.rtrim(last, F.lit(L.SPACES))), F.lit(0))
        cut = [_from(F.col(c), start, n).alias(c) for c in PIECE_TEXTS[1:]]
        return F.struct(start.cast("long").alias("pos"), d0.alias("d0"), *cut, _from(F.col("content"), start - gap, gap).alias("trivia"))

    numbered = F.transform("pieces", lambda d0, i: F.when(_opens(d0), piece(d0, i)))
    x = x.select(*keys, "suspect", F.filter(numbered, lambda p: p.isNotNull()).alias("all"))
    x = x.withColumn("given", F.flatten(F.transform("all", lambda p: _given(p["d0"], p["d1"]))))
    x = x.withColumn("all", F.filter("all", lambda p: p["d0"].rlike(declares)))
    if marks:
        x = x.withColumn("all", F.concat("all", F.array(F.lit(None))))
    return x.select(*keys, "suspect", "given", F.explode_outer("all").alias("p")).select(*keys, "p.*", "given", "suspect")


def lexed_chunks(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, chunk, start, content, src, d0, d1, d2, bad, whole (the last chunk ends
    the file well) of files cut at line ends; a file's chunks are lexed in parallel."""
    spark = files.sparkSession
    pieces = L.cut_at_lines(F.col("content"))
    c = files.select(*keys, pieces.alias("texts")).withColumn("starts", starts_of(F.col("texts")))
    c = c.select(*keys, F.size("texts").alias("chunks"), F.posexplode(F.arrays_zip("texts", "starts")).alias("chunk", "t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = c.select(*keys, "chunks", "chunk", F.col("t.starts").alias("start"), F.col("t.texts").alias("content"))
    c = materialize(c.repartition(n, *FILE_KEYS, "chunk"), "chunks")
    text, jsx = F.col("content"), L.is_jsx(F.col("path"))
    effects = materialize(c.select(*FILE_KEYS, "chunk", L.chunk_effects(text, jsx).alias("effects")), "chunk-effects")
    file_types = ", ".join(f"{k} string" for k in FILE_KEYS)
    exact = spark.createDataFrame([], f"{file_types}, chunk int, exact struct<{L.SUMMARY.replace(' ', ':')}>".replace(",:", ","))

    def followed(key, rows):
        out = L.entry_states(rows)
        for name, value in zip(FILE_KEYS, key):
            out[name] = value
        return out

    while True:
        known = effects.join(exact, [*FILE_KEYS, "chunk"], "left").groupBy(*FILE_KEYS)
        entries = materialize(known.applyInPandas(followed, f"{L.ENTRY}, {file_types}"), "chunk-entries")
        again = entries.where("open")
        if again.isEmpty():
            break
        redone = c.join(again, [*FILE_KEYS, "chunk"]).select(
            *FILE_KEYS, "chunk", L.chunk_exit(text, jsx, F.col("mode"), F.col("stack"), F.col("operand")).alias("exact")
        )
        exact = materialize(exact.unionByName(redone), "chunk-exits")
    begun = L.entry_state(F.col("mode"), F.col("stack"), F.col("operand"))
    x = c.join(entries.drop("open"), [*FILE_KEYS, "chunk"]).withColumn("x", L.lexed(text, jsx, begun))
    whole = (F.col("chunk") < F.col("chunks") - 1) | ~F.col("x.suspect")
    return materialize(
        x.select(*keys, "chunk", "start", "content", *[F.col(f"x.{t}").alias(t) for t in PIECE_TEXTS], F.col("x.state.bad").alias("bad"), whole.alias("whole")),
        "lexed-chunks",
    )


def _large_statements(files: DataFrame, keys: list[str], declares: str, marks: bool) -> DataFrame:
    """As for small files, by chunks: a statement that goes over chunk ends is put
    together from its pieces, which are numbered by the heads before them."""
    x = lexed_chunks(files, keys)
    file = Window.partitionBy(*FILE_KEYS).orderBy("chunk")
    tails = x.select(*FILE_KEYS, "chunk", F.rtrim("d0", F.lit(L.SPACES)).alias("ends")).select(*FILE_KEYS, "chunk", F.right("ends", F.lit(40)).alias("ends"))
    after_modifier = F.coalesce(F.lag("ends").over(file).rlike(rf"(?:^|[^\w$]){_any(DECL_MODIFIERS)}$"), F.lit(False))
    tails = tails.select(*FILE_KEYS, "chunk", after_modifier.alias("after_modifier"))
    x = x.join(tails, [*FILE_KEYS, "chunk"])
    x = x.withColumn("pieces", F.split("d0", HEAD, -1)).withColumn("starts", starts_of(F.col("pieces")))
    first_head = F.get("pieces", F.lit(0)).rlike(rf"^(?:{HEAD})") & ~F.col("after_modifier")
    x = x.withColumn("first_head", first_head).withColumn("heads", F.size("pieces") - 1 + F.col("first_head").cast("int"))
    before = x.select(*FILE_KEYS, "chunk", "heads").withColumn(
        "before", F.coalesce(F.sum("heads").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    x = x.drop("heads").join(before.drop("heads"), [*FILE_KEYS, "chunk"])

    def piece(d0: Column, i: Column) -> Column:
        start, n = F.get("starts", i), F.length(d0)
        cut = [_from(F.col(c), start, n).alias(c) for c in [*PIECE_TEXTS[1:], "content"]]
        number = F.col("before") + i + F.col("first_head").cast("int")
        return F.struct(number.alias("number"), (F.col("start") + start).cast("long").alias("pos"), d0.alias("d0"), *cut)

    p = x.select(*keys, "chunk", F.explode(F.transform("pieces", piece)).alias("p")).select(*keys, "chunk", "p.*")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pos", c))), lambda s: s[c]), "").alias(c)
    s = p.groupBy(*keys, "number").agg(F.min("pos").alias("pos"), *[joined(c) for c in [*PIECE_TEXTS, "content"]])
    s = materialize(s, "statements")
    gap = F.length("d0") - F.length(F.rtrim("d0", F.lit(L.SPACES)))
    trivia = s.select(*FILE_KEYS, (F.col("number") + 1).alias("number"), F.right("content", gap).alias("trivia"))
    s = s.where((F.col("number") > 0) & _opens(F.col("d0"))).join(trivia, [*FILE_KEYS, "number"], "left")
    given = s.select(*FILE_KEYS, F.explode(_given(F.col("d0"), F.col("d1"))).alias("n")).groupBy(*FILE_KEYS).agg(F.collect_set("n").alias("given"))
    marked = x.groupBy(*keys).agg((F.max("bad") | ~F.min("whole")).alias("suspect"))
    found = s.where(F.col("d0").rlike(declares)).select(*FILE_KEYS, "pos", *PIECE_TEXTS, F.coalesce("trivia", F.lit("")).alias("trivia"))
    none = F.array().cast("array<string>")
    out = marked.join(found, FILE_KEYS, "inner" if marks else "left")
    if marks:
        out = out.unionByName(marked, allowMissingColumns=True)
    out = out.join(given, FILE_KEYS, "left")
    return out.select(*keys, "pos", *PIECE_TEXTS, "trivia", F.coalesce("given", none).alias("given"), "suspect")


def statements(files: DataFrame, declares: str = DECLARATION, marks: bool = False) -> DataFrame:
    """Pieces of every file that may declare something: ``(target_dir, path, pos, d0, d1,
    d2, src, trivia, given, suspect)``, one row each; ``given`` are the names that a list
    or default export of the file gives out. A file without such a piece has a row of
    NULLs, which carries ``suspect``; with ``marks`` every file has one. Files beyond ``lexer.CHUNK`` characters are cut, so
    one of any size is worked on by many tasks; the others stay in their rows."""
    keys = FILE_KEYS + [c for c in CARRIED if c in files.columns]
    size = F.octet_length("content") if "size_bytes" not in files.columns else F.col("size_bytes")
    large = files.where((size > L.CHUNK) & (F.length("content") > L.CHUNK))
    if large.limit(1).count() == 0:
        return _small_statements(files, keys, declares, marks)
    small = files.where(~((size > L.CHUNK) & (F.length("content") > L.CHUNK)))
    return _small_statements(small, keys, declares, marks).unionByName(_large_statements(large, keys, declares, marks))


def _given(d0: Column, d1: Column) -> Column:
    """Names that an export statement gives out; a list that ends in ``from`` names
    another file's declarations."""
    listed = d0.rlike(r"^export\s+(?:type\s*)?\{_*\}(?!\s*from" + WORD_END + ")")
    inner = F.regexp_extract(d1, r"(?s)\{([^}]*)\}", 1)
    own = F.regexp_extract(d0, rf"^export\s+default\s+(?!{_any(list(KIND_RANK) + DECL_MODIFIERS)}{WORD_END})({IDENT})\s*(?:;|\n|\z)", 1)
    return F.when(listed, F.regexp_extract_all(inner, F.lit(LIST_NAMES), F.lit(1))).when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))


def named_declarations(pieces: DataFrame, kinds: list[str] | None = None, marks: bool = False) -> DataFrame:
    """Exported declarations of ``kinds``: kind, name and where the head ends; with
    ``marks``, also the rows of NULLs that :func:`statements` gives.

    A declaration is exported by its own ``export`` or by a list or default export of its
    name in the same file; it keeps its local name."""
    d0 = F.col("d0")
    kept = lambda c: c | F.col("pos").isNull() if marks else c
    t = pieces.withColumns({"kind": F.regexp_extract(d0, DECLARATION, 2), "own": F.regexp_extract(d0, DECLARATION, 3), "head": _matched(d0, DECLARATION)})
    t = t.where(kept(F.col("kind").isin(kinds or list(KIND_RANK))))
    anonymous = F.when(F.col("kind") == "function", F.lit(ANON_FUNCTION)).when(F.col("kind") == "class", F.lit(ANON_CLASS))
    # No name: `export type { A } from`, `export const type = 1` declare nothing here.
    t = t.withColumn("name", F.when(F.col("own") != "", F.col("own")).otherwise(anonymous)).where(kept(F.col("name").isNotNull()))
    return t.where(kept(d0.rlike(rf"^export{WORD_END}") | F.array_contains("given", F.col("own"))))


def declarations(pieces: DataFrame, kinds: list[str] | None = None, marks: bool = False) -> DataFrame:
    """One row for each exported declaration: DECL_KEYS, kind, name, params, return_type,
    docstring, has_body, props (all properties of an interface), suspect. With ``marks``
    also a row of each file, without ``pos``."""
    d0, src = F.col("d0"), F.col("src")
    t = named_declarations(pieces, kinds, marks)
    # What follows the name and its type parameters.
    t = t.withColumn("after", F.col("head") + _matched(_from(d0, F.col("head")), rf"^\s*{PARAMETERS}"))
    t = t.withColumn("tail", _from(d0, F.col("after")))
    kind = F.col("kind")
    fn = kind == "function"
    t = t.withColumn("lp", F.when(fn, F.col("after") + _matched(F.col("tail"), r"^\s*\(")))
    t = t.withColumn("rp", F.when(fn, _find(d0, ")", F.col("lp")))).withColumn("past", F.when(fn, _from(d0, F.col("rp") + 1)))
    t = t.withColumn("lb", F.when(kind.isin("class", "interface", "enum"), F.col("after") + _matched(F.col("tail"), BODY)))
    t = t.withColumn("rb", F.when(F.col("lb") > F.col("after"), _find(d0, "}", F.col("lb"))).otherwise(F.col("lb")))

    returned = F.col("rp") + 1 + _matched(F.col("past"), r"^\s*:")
    return_type = clean(_from(src, returned, F.length(F.regexp_extract("past", RETURN, 1))))
    is_return = _matched(F.col("past"), r"^\s*:") > 0
    eq = _matched(F.col("tail"), r"^\s*=(?![=>])")
    alias = clean(_from(src, F.col("after") + eq, F.length(F.regexp_extract(_from(d0, F.col("after") + eq), ALIAS, 1))))
    params = parameters(_from(F.col("d1"), F.col("lp"), F.col("rp") - F.col("lp")), _from(src, F.col("lp"), F.col("rp") - F.col("lp")))
    members = lambda k: _body_members(k, F.col("lb"), F.col("rb"))
    t = t.withColumns({
        "made": F.when(kind == "class", members("class")),
        "props": F.when(kind == "interface", members("interface")),
        "items": F.when(kind == "enum", members("enum")),
    })
    of_class = F.concat(
        F.filter("made", lambda m: m["grp"] == 0), F.slice(F.filter("made", lambda m: m["grp"] == 1), 1, MAX_CLASS_METHODS)
    )
    text = (
        F.when(fn, params)
        .when(kind == "class", F.array_join(F.transform(of_class, lambda m: m["text"]), " | "))
        .when(kind == "interface", F.array_join(F.slice("props", 1, MAX_INTERFACE_PROPS), "; "))
        .when(kind == "type", T.cut(F.when(eq > 0, alias).otherwise(F.lit("")), T.TYPE_TEXT_CHARS))
        .otherwise(F.array_join("items", ", "))
    )
    return t.select(
        *DECL_KEYS, "kind", "name", text.alias("params"),
        F.when(~fn, F.lit("")).when(is_return & (return_type != ""), return_type).otherwise(F.lit(MISSING_RETURN)).alias("return_type"),
        F.when(fn, jsdoc(F.col("trivia"))).alias("docstring"),
        F.when(fn, F.regexp_extract("past", ENDS_BY, 1) == "{").alias("has_body"), "props", "suspect", *[c for c in CARRIED if c in pieces.columns],
    )


def source_candidates(files: DataFrame) -> DataFrame:
    """Indexable files that can hold an exported declaration (needs the word). The text
    comes out of a generator, so filters on it don't compute a derived text again."""
    rows = files.where(P.indexable("path"))
    rows = rows.select(*[F.explode_outer(F.array(c)).alias(c) if c == "content" else c for c in rows.columns])
    return rows.where(F.contains("content", F.lit("export")))


def exported_declarations(files: DataFrame) -> DataFrame:
    """``(target_dir, path, kind, name)`` of exported declarations, without
    their members, parameters and types."""
    return named_declarations(statements(files)).select(*FILE_KEYS, "kind", "name")


def extract(files: DataFrame, kinds: list[str] | None = None, marks: bool = False) -> DataFrame:
    """:func:`declarations` of ``files``, written once to the shared folder and read with
    column pruning by every consumer; a lost executor does not replay the lexer."""
    return materialize(declarations(statements(files, marks=marks), kinds, marks), "declarations")


def suspects(files: DataFrame) -> DataFrame:
    """``(target_dir, path)`` of the files whose brackets or literals don't match: their
    exports may be missing or wrong."""
    marked = L.lexed(F.col("content"), L.is_jsx(F.col("path")), depths=0)["suspect"]
    return files.where(marked).select(*FILE_KEYS)


def without_overloads(decls: DataFrame) -> DataFrame:
    """Of a function's overloads only the one with the body. The window's partitioning by
    file serves the numbering too."""
    named = Window.partitionBy(*FILE_KEYS).orderBy("kind", "name").rangeBetween(Window.currentRow, Window.currentRow)
    any_body = F.max("has_body").over(named)
    return decls.withColumn("any_body", any_body).where(F.col("has_body").isNull() | F.col("has_body") | ~F.col("any_body")).drop("any_body")


def export_kind(decls: DataFrame, kind: str) -> DataFrame:
    d = decls.where(F.col("kind") == kind)
    d = without_overloads(d) if kind == "function" else d
    return d.select(*DECL_KEYS, "kind", "name", "params", "return_type", "docstring", "suspect")


def symbols_from(decls: DataFrame) -> DataFrame:
    """All kinds, numbered per file in kind order then source order, with ``suspect`` and
    what the files carried. One exchange, by file."""
    rank = F.create_map(*[F.lit(v) for kv in KIND_RANK.items() for v in kv])[F.col("kind")]
    w = Window.partitionBy(*FILE_KEYS).orderBy(rank, F.col("pos"))
    d = without_overloads(decls).withColumn("ord", F.row_number().over(w).cast("int"))
    return d.select(*SYMBOL_COLUMNS, "suspect", *[c for c in CARRIED if c in decls.columns])


def extract_symbols(files: DataFrame, indexable_only: bool = True) -> DataFrame:
    """``files(target_dir, path, content)`` -> ``symbols`` (SYMBOL_COLUMNS)."""
    src = source_candidates(files) if indexable_only else files.where(F.contains("content", F.lit("export")))
    return symbols_from(declarations(statements(src))).select(*SYMBOL_COLUMNS)


def compact_types(symbols: DataFrame) -> DataFrame:
    """Symbols whose types don't name the file they come from (``import("...").X`` -> ``X``)."""
    short = lambda c: F.regexp_replace(c, r'import\("[^"]*"\)\.', "").alias(c)
    return symbols.select(*[short(c) if c in ("params", "return_type") else c for c in symbols.columns])


def capped_exports(symbols: DataFrame, most: int) -> DataFrame:
    """The first ``most`` symbols of each file; a limit inside the partitions comes first."""
    w = Window.partitionBy(*FILE_KEYS).orderBy("ord")
    return symbols.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def minimal_index(files: DataFrame) -> DataFrame:
    """``(target_dir, path, kind, name)``: the least that tells where something is."""
    return exported_declarations(source_candidates(files))


def export_constants(files: DataFrame) -> DataFrame:
    """``(target_dir, path, pos, kind, name, params)`` of exported constants: kind
    ``const``, and as params the declared type, else that of a literal, else ``any``."""
    t = statements(files, CONSTANT).where("pos is not null").withColumn("head", _matched(F.col("d0"), CONSTANT))
    b = _from(F.col("d0"), F.col("head"))
    t = t.withColumn("b", F.regexp_extract(b, ALIAS, 1))
    typed = parameter(F.col("b"), _from(F.col("src"), F.col("head"), F.length("b")))
    name = F.regexp_extract("b", rf"^{IDENT}", 0)
    return t.select(*DECL_KEYS, F.lit("const").alias("kind"), name.alias("name"), F.substring(typed, F.length(name) + 3, F.length(typed)).alias("params"))
