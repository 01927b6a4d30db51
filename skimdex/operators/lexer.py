"""Lexical modes of TypeScript sources: a pushdown automaton over delimiters, folded
with ``aggregate``, and texts of equal length that show only what lies at a given depth.

Texts that patterns alone can tell take a shorter way (see ``_by_patterns``); the others
are folded, and what follows is about them.

One regex pass cuts a text into lexemes that mean the same in every context (words,
quotes, brackets, comment marks, ...). What they *are* depends on the mode: code, a
template literal or a hole in it, a comment, a string, a regex literal, a JSX tag or JSX
text. :data:`TABLE` holds the moves for (mode, lexeme class); a stack of one character
per open bracket or literal says where a closing one leads. A slash opens a regex where
an operand may stand: after an operator or a word such as ``return``, or after the ``)``
of an ``if``, ``while``, ``for`` or ``with``.

The fold gives each lexeme a code: kept, masked (inside a literal) or blank (inside a
comment), and its bracket depth up to 3. From the codes come four texts as long as the
source, so any span found in one can be cut from another:

* ``src``: the source with comments as blanks; white space inside literals is moved to
  private characters, so that blanks outside can be joined (see :func:`restored`);
* ``d0``, ``d1``, ``d2``: code at depth 0, up to 1, up to 2; everything deeper, and the
  inside of every literal, is ``_``; ``d3`` is the code of all depths.

``suspect`` marks a text whose brackets or literals don't match: its depths may be wrong
from some place on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- lexemes -----------------------------------------------------------------------

#: Words after which an operand follows, and words whose parenthesis is a condition.
OPERAND_WORDS = ["return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default"]
CONDITION_WORDS = ["if", "while", "for", "with"]
#: The first letter is looked at first: most words are none of these.
_WORDS = "(?=[acdefinortvwy])(?:" + "|".join(OPERAND_WORDS + CONDITION_WORDS) + r")(?![\w$]|[^\x00-\x7F])"
_WORD = r"(?:[\w\x{80}-\x{10FFFF}]++|\$(?!\{))++"
#: Blanks, and signs after which an operand follows and that mean nothing else.
_SIGN = r"[ \t\x0B\f\r,;:.?@!%^~#|&]++|=(?!>)|\*(?!/)|-(?!-)|\+(?!\+)"
LEXEME_RE = (
    rf"(?:{_SIGN}|(?!{_WORDS}){_WORD})++|[\n(){{}}\[\]\"'`>]"
    rf"|\\\n|\\(?!\*/)[^\n]|//|/\*|\*/|/>|\$\{{|=>|\+\+|--|</|<>|<[A-Za-z](?!\w*\s*(?:,|extends\b))"
    rf"|{_WORDS}|[\s\S]"
)

WS, NL, WORD, OPERAND, CONDITION, OP, STEP, LP, RP, LB, RB, LC, RC, DQ, SQ, BT, HOLE, SLASH, LINE, BLOCK, BLOCK_END, ESC, TAG, END_TAG, GT, SELF_END, LT, ESC_NL, FRAGMENT = range(29)
CLASSES = 29
_ONE = {"\n": NL, "(": LP, ")": RP, "[": LB, "]": RB, "{": LC, "}": RC, '"': DQ, "'": SQ, "`": BT, "/": SLASH, ">": GT, "<": LT, "\\": ESC}
_MORE = {"//": LINE, "/*": BLOCK, "*/": BLOCK_END, "/>": SELF_END, "${": HOLE, "=>": OP, "++": STEP, "--": STEP, "</": END_TAG, "<>": FRAGMENT, "\\\n": ESC_NL}

# --- modes and moves ---------------------------------------------------------------

CODE, TEMPLATE, IN_LINE, IN_BLOCK, IN_DQ, IN_SQ, REGEX, REGEX_CLASS, IN_TAG, TEXT, IN_END_TAG = range(11)
MODES = 11
#: Kinds of moves; those that test something stay in their mode where the test fails.
STAY, PUSH, POP, POP_PAREN, POP_SQUARE, POP_BRACE, PUSH_REGEX, PUSH_JSX, SWITCH = range(9)
#: Whether an operand may follow: no, yes, and after a condition word.
#: ``UNKNOWN``, at the start of a text whose beginning isn't there, passes for YES.
NO, YES, ASKED, KEEP, UNKNOWN = 0, 1, 2, 3, 4
#: Mode and operand state after the symbol is popped.
AFTER = {
    "(": (CODE, NO), "c": (CODE, YES), "[": (CODE, NO), "{": (CODE, YES), "h": (TEMPLATE, NO), "A": (IN_TAG, NO), "H": (TEXT, NO),
    "q": (CODE, NO), "Q": (IN_TAG, NO), "k": (CODE, KEEP), "K": (IN_TAG, KEEP), "p": (CODE, NO), "e": (CODE, NO), "E": (TEXT, NO),
}
LITERALS = "qQkKpeE"
CLOSER = {RP: 1, RB: 2, RC: 3}
#: (mode, class) -> (kind, next mode, pushed symbol, operand state).
TABLE = {
    **{(CODE, c): (STAY, CODE, "", KEEP) for c in (WS, NL, ESC, ESC_NL, STEP)},
    **{(CODE, c): (STAY, CODE, "", YES) for c in (OP, OPERAND, BLOCK_END, END_TAG, GT, LT)},
    (CODE, WORD): (STAY, CODE, "", NO), (CODE, CONDITION): (STAY, CODE, "", ASKED),
    (CODE, LP): (PUSH, CODE, "(", YES), (CODE, LB): (PUSH, CODE, "[", YES), (CODE, LC): (PUSH, CODE, "{", YES), (CODE, HOLE): (PUSH, CODE, "{", YES),
    (CODE, RP): (POP_PAREN, CODE, "", YES), (CODE, RB): (POP_SQUARE, CODE, "", YES), (CODE, RC): (POP_BRACE, CODE, "", YES),
    (CODE, DQ): (PUSH, IN_DQ, "q", NO), (CODE, SQ): (PUSH, IN_SQ, "q", NO), (CODE, BT): (PUSH, TEMPLATE, "p", NO),
    (CODE, SLASH): (PUSH_REGEX, REGEX, "q", YES), (CODE, SELF_END): (PUSH_REGEX, REGEX, "q", YES),
    (CODE, LINE): (PUSH, IN_LINE, "k", KEEP), (CODE, BLOCK): (PUSH, IN_BLOCK, "k", KEEP),
    (CODE, TAG): (PUSH_JSX, IN_TAG, "e", YES), (CODE, FRAGMENT): (PUSH_JSX, TEXT, "e", YES),
    (TEMPLATE, BT): (POP, 0, "", NO), (TEMPLATE, HOLE): (PUSH, CODE, "h", YES),
    (IN_LINE, NL): (POP, 0, "", NO), (IN_LINE, ESC_NL): (POP, 0, "", NO), (IN_BLOCK, BLOCK_END): (POP, 0, "", NO),
    (IN_DQ, DQ): (POP, 0, "", NO), (IN_DQ, NL): (POP, 0, "", NO), (IN_SQ, SQ): (POP, 0, "", NO), (IN_SQ, NL): (POP, 0, "", NO),
    **{(REGEX, c): (POP, 0, "", NO) for c in (SLASH, SELF_END, BLOCK_END, LINE, BLOCK, END_TAG, NL)},
    (REGEX, LB): (SWITCH, REGEX_CLASS, "", NO), (REGEX_CLASS, RB): (SWITCH, REGEX, "", NO), (REGEX_CLASS, NL): (POP, 0, "", NO),
    (IN_TAG, GT): (SWITCH, TEXT, "", NO), (IN_TAG, SELF_END): (POP, 0, "", NO), (IN_TAG, LC): (PUSH, CODE, "A", YES), (IN_TAG, HOLE): (PUSH, CODE, "A", YES),
    (IN_TAG, DQ): (PUSH, IN_DQ, "Q", NO), (IN_TAG, SQ): (PUSH, IN_SQ, "Q", NO), (IN_TAG, LINE): (PUSH, IN_LINE, "K", KEEP), (IN_TAG, BLOCK): (PUSH, IN_BLOCK, "K", KEEP),
    (TEXT, LC): (PUSH, CODE, "H", YES), (TEXT, HOLE): (PUSH, CODE, "H", YES), (TEXT, TAG): (PUSH, IN_TAG, "E", NO), (TEXT, FRAGMENT): (PUSH, TEXT, "E", NO),
    (TEXT, END_TAG): (SWITCH, IN_END_TAG, "", NO), (IN_END_TAG, GT): (POP, 0, "", NO),
}

#: Lexemes of one inner fold: its codes are appended to the text's once.
BLOCK_LEXEMES = 256
KEPT, MASKED, BLANK = range(3)
CODES = "0123abcdstuv"
DEPTHS = 4
FILL = "_"
SPACES, PRIVATE = " \t\n\r\x0b\x0c", ""
OPERANDS = 5

# A step is a look-up by number, so that it evaluates few expressions. The state is
# ``at`` (mode and operand state), the stack and ``place``: the code of a lexeme that
# stays, which is a number in CODES (code at a depth, or inside a literal or comment that
# began at a depth). On the stack the outermost literal has a symbol of its own, so that
# leaving it is seen from the symbol.
OUTERMOST = {"q": "1", "k": "2", "p": "3", "e": "4"}
_STAYS, _ENTERS, _LEAVES = range(3)


def _ints(values) -> Column:
    """A literal array; one folded constant, however long."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")


def _chars(text: str) -> Column:
    return F.split(F.lit(text), "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once. A fold over nothing hands its start
    to its end. ``get`` of a one-element ``transform`` would do too, but asks for its type
    at each evaluation, at twice the work for every ``let`` inside."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


_BLANKS = "\ufeff\xa0"


def _with_blanks(text: Column) -> Column:
    rare = F.contains(text, F.lit(_BLANKS[0])) | F.contains(text, F.lit(_BLANKS[1]))
    return F.when(rare, F.translate(text, _BLANKS, "  ")).otherwise(text)


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(_with_blanks(text), F.lit(LEXEME_RE), F.lit(0))


def lexeme_class(x: Column) -> Column:
    one = _ints(_ONE.get(chr(i), WORD if chr(i).isalnum() or chr(i) in "_$" else WS if chr(i) in SPACES or i == 0 else OP) for i in range(128))
    of = lambda c: F.coalesce(F.get(one, F.ascii(c)), F.lit(WORD))
    # A run of words and signs is what its last one is; these may be something else.
    marks, words = {m[0] for m in _MORE}, {w[0] for w in OPERAND_WORDS + CONDITION_WORDS}
    start = F.get(_ints(1 if chr(i) in marks else 2 if chr(i) in words else 0 for i in range(128)), F.ascii(x))
    more = F.when(x == "\\\n", ESC_NL)
    for text, c in _MORE.items():
        more = more.when(x == text, c)
    more = more.when(F.ascii(x) == ord("\\"), ESC).when(F.ascii(x) == ord("<"), TAG)
    run = of(F.right(F.rtrim(x, F.lit(SPACES)), F.lit(1)))
    word = F.when(x.isin(OPERAND_WORDS + CONDITION_WORDS), F.when(x.isin(CONDITION_WORDS), CONDITION).otherwise(OPERAND)).otherwise(run)
    single = F.when(x == "\0", OP).otherwise(of(x))
    return F.when(F.length(x) == 1, single).when(start == 2, word).when(start == 1, more.otherwise(run)).otherwise(run)


def _moves() -> dict[str, list[int]]:
    """For (mode, operand state, class): what happens, ``at`` afterwards (if nothing is
    left), the pushed symbol and how it changes the place, how a symbol is left."""
    out = {"does": [], "next": [], "push": [], "enter": [], "relied": []}
    for mode in range(MODES):
        for operand in range(OPERANDS):
            for cls in range(CLASSES):
                kind, to, symbol, state = TABLE.get((mode, cls), (STAY, mode, "", KEEP))
                enters = kind == PUSH or (kind in (PUSH_REGEX, PUSH_JSX) and operand != NO)
                symbol = "c" if symbol == "(" and operand == ASKED else symbol
                leaves = POP <= kind <= POP_BRACE
                out["does"].append(_ENTERS if enters else _LEAVES + kind - POP if leaves else _STAYS)
                out["next"].append((to if enters or kind == SWITCH else mode) * OPERANDS + (operand if state == KEEP else state))
                out["push"].append(ord(symbol) if enters else 0)
                begins = KEPT if cls in (DQ, SQ, BT) else BLANK if cls in (LINE, BLOCK) else MASKED
                out["enter"].append((1 + begins if symbol in LITERALS else 0) if enters else 0)
                out["relied"].append(operand == UNKNOWN and (kind in (PUSH_REGEX, PUSH_JSX) or cls == LP))
    return out


def _left() -> list[int]:
    """For (kind of leaving, operand state, symbol): ``at`` after the symbol is left, -1 if
    it isn't the one to leave."""
    fits = {POP: set(AFTER), POP_PAREN: set("(c"), POP_SQUARE: set("["), POP_BRACE: set("{hAH")}
    plain = {v: k for k, v in OUTERMOST.items()}
    out = []
    for kind in range(POP, POP_BRACE + 1):
        for operand in range(OPERANDS):
            for symbol in map(chr, range(128)):
                symbol = plain.get(symbol, symbol)
                mode, state = AFTER.get(symbol, (CODE, KEEP))
                out.append(mode * OPERANDS + (operand if state == KEEP else state) if symbol in fits[kind] else -1)
    return out


def _step(inner: bool):
    """One move of the automaton: state and class -> state with the lexeme's code added.
    An ``inner`` text begins inside a file: ``under`` are the brackets it closes that were
    opened before it, and ``relied`` says whether a move depended on the unknown operand
    state."""
    tables = _moves()
    does, nexts, enter, relied = (_ints(tables[k]) for k in ("does", "next", "enter", "relied"))
    pushes, left = _ints(tables["push"]), _ints(_left())
    codes, places = _chars(CODES), range(len(CODES))
    # Place after a bracket, or a literal that begins kept, masked or blank; and its code.
    # In a literal nothing changes.
    began = lambda e, z: z if z >= DEPTHS else min(z + 1, DEPTHS - 1) if e == 0 else DEPTHS * (BLANK if e == 1 + BLANK else MASKED) + z
    entered = _ints(began(e, z) for e in range(4) for z in places)
    enter_codes = _chars("".join(CODES[z if z >= DEPTHS or e == 0 else DEPTHS * (e - 1) + z] for e in range(4) for z in places))
    # Code of the lexeme that ends the outermost literal.
    ends = lambda c, z: KEPT if c in (DQ, SQ, BT, NL) else BLANK if c == ESC_NL else z // DEPTHS if c == BLOCK_END else MASKED
    end_codes = _chars("".join(CODES[DEPTHS * ends(c, z) + z % DEPTHS] for c in range(CLASSES) for z in places))
    outermost = [ord(c) for c in OUTERMOST.values()]
    marked = _ints(ord(OUTERMOST.get(chr(i), chr(i))) for i in range(128))
    under_text = _chars("".join({RP: ")", RB: "]", RC: "}"}.get(c, " ") for c in range(CLASSES)))

    def state(s: Column, cls: Column, at: Column, stack: Column, place: Column, bad: Column, code: Column, under: Column | None = None) -> Column:
        fields = [at.alias("at"), stack.alias("stack"), place.alias("place"), bad.alias("bad")]
        if inner:
            fields += [(s["under"] if under is None else under).alias("under"), (s["relied"] | (F.get(relied, s["at"] * CLASSES + cls) == 1)).alias("relied")]
        return F.struct(*fields, F.concat(s["codes"], code).alias("codes"))

    def move(s: Column, cls: Column) -> Column:
        key = s["at"] * CLASSES + cls
        stays = state(s, cls, F.get(nexts, key), s["stack"], s["place"], s["bad"], F.get(codes, s["place"]))
        return F.when(F.get(does, key) == _STAYS, stays).when(F.get(does, key) == _ENTERS, pushed(s, cls, key)).otherwise(
            # A closing brace ends parentheses that were left open inside it.
            let(F.when(F.get(does, key) == _LEAVES + POP_BRACE - POP, F.rtrim(s["stack"], F.lit("([c"))).otherwise(s["stack"]), lambda k: popped(s, cls, key, k))
        )

    def pushed(s: Column, cls: Column, key: Column) -> Column:
        change = F.get(enter, key) * len(CODES) + s["place"]
        symbol = F.get(pushes, key)
        symbol = F.when(s["place"] < DEPTHS, F.get(marked, symbol)).otherwise(symbol)
        return state(s, cls, F.get(nexts, key), F.concat(s["stack"], F.char(symbol)), F.get(entered, change), s["bad"], F.get(enter_codes, change))

    def popped(s: Column, cls: Column, key: Column, stack: Column) -> Column:
        top = F.ascii(F.right(stack, F.lit(1)))
        at = F.get(left, ((F.get(does, key) - _LEAVES) * OPERANDS + s["at"] % OPERANDS) * 128 + top)
        return let(F.struct(at.alias("at"), top.alias("top")), lambda k: leaves(s, cls, key, stack, k))

    def leaves(s: Column, cls: Column, key: Column, stack: Column, k: Column) -> Column:
        closes, place = F.get(does, key) > _LEAVES, s["place"]
        size = F.length(stack) - 1
        code_place = F.least(size, F.lit(DEPTHS - 1))
        out = k["top"].isin(outermost)
        new_place = F.when(place < DEPTHS, code_place).when(out, place % DEPTHS).otherwise(place)
        code = F.when(place < DEPTHS, F.get(codes, code_place)).when(out, F.get(end_codes, cls * len(CODES) + place)).otherwise(F.get(codes, place))
        trimmed = s["bad"] | (closes & (stack != s["stack"]))
        gone = state(s, cls, k["at"], F.left(stack, size), new_place, trimmed, code)
        wrong = state(s, cls, F.get(nexts, key), s["stack"], place, s["bad"] | closes, F.get(codes, place))
        if inner:
            operand = F.when(cls == RC, YES).otherwise(NO)
            below = state(s, cls, s["at"] - s["at"] % OPERANDS + operand, F.lit(""), F.lit(0), trimmed, F.lit(CODES[0]), F.concat(s["under"], F.get(under_text, cls)))
            return F.when(k["at"] >= 0, gone).when(closes & (k["top"] == 0), below).otherwise(wrong)
        return F.when(k["at"] >= 0, gone).otherwise(wrong)

    return move


def first_literal(stack: Column) -> Column:
    """Place of the outermost literal on a stack, -1 if there is none."""
    return F.regexp_instr(stack, F.lit(f"[{LITERALS}]")) - 1


def entry_state(mode: Column | None = None, stack: Column | None = None, operand: Column | None = None, inner: bool = False) -> Column:
    """The state a text begins in: a file's start, or the given one."""
    if mode is None:
        at, own, place = F.lit(CODE * OPERANDS + YES), F.lit(""), F.lit(0)
    else:
        lit = first_literal(stack)
        symbol = F.substring(stack, lit + 1, F.lit(1))
        own = F.when(lit < 0, stack).otherwise(F.concat(F.left(stack, lit), F.translate(symbol, "".join(OUTERMOST), "".join(OUTERMOST.values())), F.substring(stack, lit + 2, F.length(stack))))
        inside = F.when(symbol == "k", BLANK * DEPTHS).otherwise(MASKED * DEPTHS)
        place = F.when(lit < 0, F.least(F.length(stack), F.lit(DEPTHS - 1))).otherwise(F.least(lit, F.lit(DEPTHS - 1)) + inside)
        at = mode * OPERANDS + operand
    fields = [at.cast("int").alias("at"), own.alias("stack"), place.cast("int").alias("place"), F.lit(False).alias("bad")]
    if inner:
        fields += [F.lit("").alias("under"), F.lit(False).alias("relied")]
    return F.struct(*fields, F.lit("").alias("codes"))


def fold(classes: Column, jsx: Column, entry: Column | None = None, inner: bool = False) -> Column:
    """The automaton's state after all lexemes, with ``codes``: a character for each.
    Blocks of lexemes are folded by themselves, so codes are not copied at each step."""
    step = _step(inner)
    names = ["at", "stack", "place", "bad", *(["under", "relied"] if inner else [])]
    # Where there is no JSX, what may open a tag is a sign.
    classes = F.when(jsx, classes).otherwise(F.transform(classes, lambda c: F.when(c.isin(TAG, FRAGMENT), F.lit(LT)).otherwise(c)))

    def folded(given: Column) -> Column:
        def block(state: Column, start: Column) -> Column:
            fresh = F.struct(*[state[f].alias(f) for f in names], F.lit("").alias("codes"))
            inside = F.aggregate(F.slice(given, start, BLOCK_LEXEMES), fresh, step)
            return let(inside, lambda s: F.struct(*[s[f].alias(f) for f in names], F.concat(state["codes"], s["codes"]).alias("codes")))

        n = F.size(given)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(BLOCK_LEXEMES))).otherwise(F.array().cast("array<int>"))
        return let(F.aggregate(starts, entry_state(inner=inner) if entry is None else entry, block), outside)

    def outside(s: Column) -> Column:
        stack = F.translate(s["stack"], "".join(OUTERMOST.values()), "".join(OUTERMOST))
        own = [F.floor(s["at"] / OPERANDS).cast("int").alias("mode"), stack.alias("stack"), (s["at"] % OPERANDS).alias("operand"), s["bad"].alias("bad")]
        return F.struct(*own, *[(s[f] if inner else F.lit(v)).alias(f) for f, v in (("under", ""), ("relied", False))], s["codes"].alias("codes"))

    return let(classes, folded)


def _blank(x: Column) -> Column:
    spaces = F.repeat(F.lit(" "), F.length(x))
    return F.when(F.endswith(x, F.lit("\n")), F.concat(F.left(spaces, F.length(x) - 1), F.lit("\n"))).otherwise(spaces)


def _at_depth(words: Column, codes: Column, depth: int) -> Column:
    kept, blank, last = CODES[depth], CODES[BLANK * DEPTHS], CODES[BLANK * DEPTHS + depth]
    piece = lambda x, c: F.when(c <= kept, x).when((c >= blank) & (c <= last), _blank(x)).otherwise(F.repeat(F.lit(FILL), F.length(x)))
    return F.array_join(F.zip_with(words, codes, piece), "")


def _source(words: Column, codes: Column) -> Column:
    piece = lambda x, c: F.when(c <= CODES[DEPTHS - 1], x).when(c >= CODES[BLANK * DEPTHS], _blank(x)).otherwise(F.translate(x, SPACES, PRIVATE))
    return F.array_join(F.zip_with(words, codes, piece), "")


def restored(text: Column) -> Column:
    """A piece of ``src`` with the white space of its literals."""
    return F.translate(text, PRIVATE, SPACES)


def complete(state: Column) -> Column:
    """Whether a text that ends in ``state`` is balanced; a line comment may end it."""
    open_comment = (state["mode"] == IN_LINE) & (state["stack"] == "k")
    return ~state["bad"] & (((state["mode"] == CODE) & (state["stack"] == "")) | open_comment)


# --- texts that need no modes ------------------------------------------------------
#
# Most texts are told by patterns alone: one cuts a text into literals, comments and the
# code between them, another the code into groups of brackets, each group's inside again
# for each depth. A text goes the automaton's way if a piece is left over (a quote without
# an end, a slash that may be a division or a regex, a hole with brackets in it, a
# backslash in code, a bracket without its closer but for a brace too many), if what may be
# JSX stands in it but for plain elements, if a bracket is closed by another's closer, or
# if brackets stand deeper than GROUP_DEPTH.

_OPERAND = rf"(?<![\w$<\x{{80}}-\x{{10FFFF}}])(?:{'|'.join(OPERAND_WORDS + CONDITION_WORDS)})"
_CONDITION = rf"(?<![\w$<\x{{80}}-\x{{10FFFF}}])(?:{'|'.join(CONDITION_WORDS)})[ \t]{{0,9}}\([^()\[\]{{}}\"'`/\\\n<]{{0,200}}\)"
#: A slash after a word or an index divides; one after an operator, an operand word or a
#: condition opens a regex literal. What stands between are blanks of the same line.
_DIVISION = rf"(?=/)(?<=[\w$\]][ \t]{{0,9}})(?<!{_OPERAND}[ \t]{{0,9}})(?<!<[\w$]{{1,12}}[ \t]{{0,9}})/(?![/*>])"
_REGEX = (
    rf"(?=/)(?<=(?:[(\[{{}},;:=!&|?%^~>]|{_OPERAND}|{_CONDITION})[ \t]{{0,9}})/(?![/*>])"
    r"(?:[^/\\\n\[]|\\[^\n*]|\[(?:[^\]\\\n]|\\[^\n*])*+\])++/(?![/*>])"
    rf"(?!{_WORDS})"
)
_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+`"
#: Templates with holes that hold words, signs, strings and templates, this deep.
for _ in range(2):
    _TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:[^(){{}}\[\]\"'`/\\<]|{_STRING}|{_TEMPLATE})*+\}})*+`"
_COMMENT = r"(?<![*<])(?://[^\n]*+|/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/)"
_RUN_SIGNS = r"[^\"'`/\\]"
UNIT_RE = rf"(?:{_RUN_SIGNS}++|{_DIVISION})++|{_STRING}|{_TEMPLATE}|{_COMMENT}|{_REGEX}|[\s\S]"


def _element() -> str:
    """A JSX element where an operand follows for sure: after a sign on the same line, or
    after one that ends the line before (which holds no comment mark). Its holes hold
    words, signs, strings, elements, and parentheses without elements; an element with
    anything else is left to the automaton."""
    text = r"\"[^\"\\\n]*+\"|'[^'\\\n]*+'"
    sign, same = r"[=(\[,;:?&|]", r"[ \t]{0,9}"
    line_before = rf"(?<=[ \t\n])(?<=\n[ \t]{{0,60}})(?<=(?:\A|\n)[^\n/*]{{0,120}}{sign}{same}\n[ \t]{{0,60}})"
    operand = rf"(?=<[A-Za-z])(?:(?<={sign}{same})|{line_before})"
    plain = rf"[^(){{}}\[\]\"'`/\\<>=]++|=(?!>)|=>|{text}"
    held = rf"{plain}|\((?:{plain}|\((?:{plain})*+\))*+\)"
    tag = rf"<[A-Za-z](?!\w*\s*(?:,|extends\b))(?:[^<>{{}}\"'`/\\$=]++|=(?!>)|{text}|\{{(?:{held})*+\}})*+"
    nested = rf"{tag}/>"
    for _ in range(4):
        nested = rf"{tag}(?:/>|>(?:[^<{{}}\\$]++|\{{(?:{held}|{operand}{nested})*+\}}|{nested})*+</[A-Za-z][\w.]*+\s*+>)"
    return rf"{operand}{nested}(?![ \t]*[/<])"


_ELEMENT = _element()
#: As :data:`UNIT_RE` where there may be JSX; a ``<`` that begins a unit is an element's.
JSX_UNIT_RE = (
    rf"(?:[^\"'`/\\<]|{_DIVISION})(?:[^\"'`/\\<]++|{_DIVISION}|(?!{_ELEMENT})<)*+"
    rf"|{_STRING}|{_TEMPLATE}|{_COMMENT}|{_ELEMENT}|{_REGEX}|[\s\S]"
)
#: What follows is looked at first: what stands before takes much longer to test.
MAYBE_JSX = rf"(?=<[A-Za-z>])(?:(?<![\w$])|(?<={_OPERAND})|(?<=<[A-Za-z]))(?:<>|<[A-Za-z](?!\w*\s*(?:,|extends\b)))"
#: A bracket with all up to the one that closes it, of whatever kind, this deep.
GROUP_DEPTH = 12
_GROUP = r"[(\[{][^(){}\[\]]*+[)\]}]"
for _ in range(GROUP_DEPTH - 1):
    _GROUP = rf"[(\[{{](?:[^(){{}}\[\]]++|{_GROUP})*+[)\]}}]"
PIECE_RE = rf"[^(){{}}\[\]]++|{_GROUP}|[\s\S]"
_INSIDE = rf"(?:[^(){{}}\[\]]++|{_GROUP})*+"
#: A bracket that another's closer ends.
CROSSED = rf"(?=[(\[{{])(?:\({_INSIDE}[\]}}]|\[{_INSIDE}[)}}]|\{{{_INSIDE}[)\]])"


def _blanked(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\n]", " ")


def _unit(x: Column, jsx: bool) -> Column:
    """A unit as code shows it; NULL if it is one that is left over."""
    first, n = F.ascii(x), F.length(x)
    quoted = F.concat(F.left(x, F.lit(1)), F.repeat(F.lit(FILL), n - 2), F.left(x, F.lit(1)))
    slashed = F.when(F.substring(x, 2, 1).isin("/", "*"), _blanked(x)).otherwise(F.repeat(F.lit(FILL), n))
    is_quote = first.isin(ord('"'), ord("'"), ord("`"))
    told = F.when(is_quote, F.when(n > 1, quoted)).when(first == ord("/"), F.when(n > 1, slashed))
    if jsx:
        told = told.when(first == ord("<"), F.when(n > 1, F.repeat(F.lit(FILL), n)))
    return told.when(first != ord("\\"), x).when(n == 0, x)


def _unit_source(x: Column, jsx: bool) -> Column:
    first = F.ascii(x)
    literal = first.isin(*map(ord, "\"'`/<" if jsx else "\"'`/"))
    comment = (first == ord("/")) & F.substring(x, 2, 1).isin("/", "*")
    return F.when(~literal, x).when(comment, _blanked(x)).otherwise(F.translate(x, SPACES, PRIVATE))


def _pieces(code: Column) -> Column:
    """Groups of brackets whole, what stands between them, and brackets left over."""
    return F.regexp_extract_all(code, F.lit(PIECE_RE), F.lit(0))


def _is_group(x: Column) -> Column:
    return F.ascii(x).isin(*map(ord, "([{"))


def _within(x: Column, inner: Column) -> Column:
    return F.concat(F.left(x, F.lit(1)), inner, F.right(x, F.lit(1)))


def _filled(x: Column) -> Column:
    return F.when(_is_group(x), _within(x, F.repeat(F.lit(FILL), F.length(x) - 2))).otherwise(x)


def _shown(x: Column, deepest: int) -> Column:
    """Struct of a piece as code of depth 0 shows it, up to depth 1, .. ``deepest``. A
    group's inside is cut once for all depths."""
    names = [f"d{k}" for k in range(deepest + 1)]
    if deepest == 0:
        return F.struct(_filled(x).alias("d0"))

    def opened(inside: Column) -> Column:
        at = [F.array_join(inside[f"d{k}"], "") for k in range(deepest)]
        return F.struct(_filled(x).alias("d0"), *[_within(x, t).alias(n) for t, n in zip(at, names[1:])])

    def parted(inside: Column) -> Column:
        inner = F.transform(_pieces(inside), lambda p: _shown(p, deepest - 1))
        return F.when(inside.rlike(r"[(\[{]"), let(inner, opened)).otherwise(F.struct(_filled(x).alias("d0"), *[x.alias(n) for n in names[1:]]))

    whole = F.struct(*[x.alias(n) for n in names])
    return F.when(_is_group(x), let(F.substring(x, F.lit(2), F.length(x) - 2), parted)).otherwise(whole)


def _by_patterns(text: Column, jsx: Column, depths: int, elements: bool = False) -> Column:
    """What :func:`lexed` gives, NULL for a text that needs the automaton. With
    ``elements``, for texts that may hold JSX, plain elements are literals."""

    def texts(source: Column, code: Column, pieces: Column) -> Column:
        suspect = F.array_contains(pieces, "}").alias("suspect")
        shown = min(depths, DEPTHS - 1)
        if shown == 0:
            return F.struct(source.alias("src"), suspect)
        last = [code.alias(f"d{k}") for k in range(shown, depths)]
        made = lambda at: F.struct(source.alias("src"), *[F.array_join(at[f"d{k}"], "").alias(f"d{k}") for k in range(shown)], *last, suspect)
        return let(F.transform(pieces, lambda p: _shown(p, shown - 1)), made)

    def grouped(source: Column, code: Column) -> Column:
        left = F.array(*[F.lit(c) for c in "([{)]"])
        crossed = F.regexp_replace(code, r"[^(){}\[\]]++", "").rlike(CROSSED)
        return let(_pieces(code), lambda p: F.when(~(F.arrays_overlap(p, left) | crossed), texts(source, code, p)))

    def cut(t: Column) -> Column:
        units = F.regexp_extract_all(t, F.lit(JSX_UNIT_RE if elements else UNIT_RE), F.lit(0))
        source = lambda u: F.array_join(F.transform(u, lambda x: _unit_source(x, elements)), "")
        code = lambda u: F.array_join(F.transform(u, lambda x: _unit(x, elements)), "")
        told = lambda c: (F.length(c) == F.length(t)) & ~(jsx & c.rlike(MAYBE_JSX))
        return let(units, lambda u: let(code(u), lambda c: F.when(told(c), let(source(u), lambda own: grouped(own, c)))))

    return let(_with_blanks(text), cut)


def _by_modes(text: Column, jsx: Column, entry: Column | None, depths: int) -> Column:
    def texts(words: Column, state: Column, codes: Column) -> Column:
        at = [_at_depth(words, codes, k).alias(f"d{k}") for k in range(depths)]
        end = [] if entry is None else [state.dropFields("codes").alias("state")]
        return F.struct(_source(words, codes).alias("src"), *at, (~complete(state)).alias("suspect"), *end)

    with_codes = lambda words, s: let(F.split(s["codes"], ""), lambda codes: texts(words, s, codes))
    return let(lexemes(text), lambda words: let(F.transform(words, lexeme_class), lambda classes: let(fold(classes, jsx, entry), lambda s: with_codes(words, s))))


def lexed(text: Column, jsx: Column, entry: Column | None = None, depths: int = 3) -> Column:
    """Struct of ``src``, ``d0`` .. of ``depths`` depths and ``suspect``; for a text that
    begins in an ``entry`` state also ``state``, that at its end."""
    by_modes = _by_modes(text, jsx, entry, depths)
    if entry is not None:
        return by_modes
    by_patterns = F.when(jsx, _by_patterns(text, F.lit(True), depths, elements=True)).otherwise(_by_patterns(text, F.lit(False), depths))
    return F.coalesce(by_patterns, by_modes)


def is_jsx(path: Column) -> Column:
    return F.lower(path).rlike(r"\.[jt]sx$")


# --- large texts -------------------------------------------------------------------
#
# A text of more than CHUNK characters is cut at line ends. What a chunk does to the
# stack is found for every mode it may begin in, all chunks at once; following the chunks
# of a file through these answers gives the state each begins in, and with it each chunk
# is lexed by itself. A chunk that no answer fits (a hole opened before it is closed in
# it, say) is folded again from its true state; the others' answers stay.

CHUNK = 1 << 16
#: States a chunk may begin in: mode and the stack's last symbol.
VARIANTS = [(CODE, ""), (TEMPLATE, "p"), (IN_BLOCK, "k"), (TEXT, "e"), (IN_TAG, "e")]
SUMMARY = "mode int, stack string, operand int, bad boolean, under string, relied boolean"
ENTRY = "chunk int, mode int, stack string, operand int, open boolean"


def cut_at_lines(text: Column) -> Column:
    """Chunks of at least CHUNK characters, to the end of the line, in one pass."""
    return F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{CHUNK}}}+[^\n]*+\n?+"), F.lit(0))


def _summary(state: Column) -> Column:
    return F.struct(*[state[c.split()[0]].alias(c.split()[0]) for c in SUMMARY.split(", ")])


def chunk_effects(text: Column, jsx: Column) -> Column:
    """What a chunk does, for each of VARIANTS."""
    begun = lambda m, b: entry_state(F.lit(m), F.lit(b), F.lit(UNKNOWN), inner=True)
    return let(F.transform(lexemes(text), lexeme_class), lambda c: F.array(*[_summary(fold(c, jsx, begun(m, b), inner=True)) for m, b in VARIANTS]))


def chunk_exit(text: Column, jsx: Column, mode: Column, stack: Column, operand: Column) -> Column:
    """What a chunk does from its true state."""
    return _summary(fold(F.transform(lexemes(text), lexeme_class), jsx, entry_state(mode, stack, operand)))


def follow(state: tuple[int, str, int], effects: list) -> tuple[int, str, int] | None:
    """The state after a chunk that begins in ``state``, from its effects for VARIANTS;
    None if they don't tell."""
    mode, stack, operand = state
    for (m, base), e in zip(VARIANTS, effects):
        if m != mode or (base and not stack):
            continue
        last, below = (stack[-1], stack[:-1]) if base else ("", stack)
        kept = base and e["stack"][:1] == base and not e["under"]
        if base and last != base and not kept:
            continue  # it closes another literal than that it was tried with
        if e["relied"] and operand != YES:
            return None
        for closer in e["under"]:
            if closer == "}":
                below = below.rstrip("([c")
            if below[-1:] in ("h", "A", "H") or (closer == ")" and below[-1:] == "c"):
                return None  # what is closed decides how the text goes on
            if below[-1:] == {")": "(", "]": "[", "}": "{"}[closer]:
                below = below[:-1]
        pushed = last + e["stack"][1:] if kept else e["stack"]
        return e["mode"], below + pushed, operand if e["operand"] == UNKNOWN else e["operand"]
    return None


def entry_states(chunks):
    """Rows of one file (chunk, effects, exact exit or NULL, from which true state) ->
    the state each chunk begins in, up to the first chunk that has to be folded from its
    true state (``open``)."""
    import pandas as pd

    out, state = [], (CODE, "", YES)
    for row in chunks.sort_values("chunk").itertuples(index=False):
        exact = row.exact
        known = exact is not None and (exact["mode"], exact["stack"], exact["operand"])
        after = known or follow(state, list(row.effects))
        out.append((row.chunk, *state, after is None))
        if after is None:
            break
        state = after
    return pd.DataFrame(out, columns=["chunk", "mode", "stack", "operand", "open"])
