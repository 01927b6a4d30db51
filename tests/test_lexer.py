"""Lexical modes, masked texts of equal length, and what they give the extraction."""

import random

import pytest
from conftest import make_files
from pyspark.sql import functions as F

from skimdex.operators import lexer as L
from skimdex.operators import skeleton as K
from skimdex.operators import symbols as Y
from skimdex.operators import tokens as TK

# (file, source, depth-0 text with the filler shortened to one "_", suspect)
CASES = [
    ("nested.ts", "`x ${ `y } ${b}` } {` + 1;", "`_` + 1;", False),
    ("hole.ts", "const a = `p${f({ k: '}' })}q`; b {", "const a = `_`; b {", True),
    ("regex.ts", "if (ok) /[{(]/.test(x);\ny = a / b / c; z = f(a) / 2", "if (_) _.test(_);\ny = a / b / c; z = f(_) / 2", False),
    ("after.ts", "return /}/g; while (x) /{/.exec(y); (a) / b", "return _g; while (_) _.exec(_); (_) / b", False),
    ("class.ts", "s = /[/\\]{]+/; t = /\\//; u = /a*/; v = /\\*/", "s = _; t = _; u = _; v = _", False),
    ("comment.ts", "a // it's {\nb /* `{ \n */ c", "a          \nb       \n    c", False),
    ("string.ts", "'it\\'s {' + \"http://x/*\" + '\\\\' ;", "'_' + \"_\" + '_' ;", False),
    ("open.ts", "x = 'no end {\ny = 1", "x = '_\ny = 1", False),
    ("line.ts", "// c:\\\nlet a = 1", "      \nlet a = 1", False),
    ("view.tsx", "const v = <p t=\"{\" u={ {a: 1} }>don't {ok ? <b/> : `}`} <i>}</i></p>;\nf(1)", "const v = _;\nf(_)", False),
    ("frag.tsx", "return (<><A.B/>it's</>) + 1", "return (_) + 1", False),
    ("generic.tsx", "const f = <T,>(x: T) => x; const g = a < b && c > d;", "const f = <T,>(_) => x; const g = a < b && c > d;", False),
    ("cast.ts", "const f = <T>(x: T) => <div>x", "const f = <T>(_) => <div>x", False),
    ("extra.ts", "f(a) }\ng(b)", "f(_) }\ng(_)", True),
    ("missing.ts", "{ (a }\nb", "{_}\nb", True),
    ("empty.ts", "", "", False),
    ("mark.ts", "﻿export const a = 1", " export const a = 1", False),
]


@pytest.fixture(scope="module")
def lexed(spark):
    d = spark.createDataFrame([(p, s) for p, s, *_ in CASES], "path string, content string")
    rows = d.select("path", L.lexed(F.col("content"), L.is_jsx(F.col("path")), depths=4).alias("x")).collect()
    return {r.path: r.x for r in rows}


@pytest.mark.parametrize("path,source,d0,suspect", CASES, ids=[c[0] for c in CASES])
def test_modes(lexed, path, source, d0, suspect):
    import re

    x = lexed[path]
    assert re.sub("_+", "_", x.d0) == d0
    assert x.suspect == suspect
    assert {len(x[k]) for k in ("src", "d0", "d1", "d2", "d3")} == {len(source)}


def plain_lexer(text):
    """A character loop for code, strings, comments and templates: depth of each bracket
    that is one, by position."""
    out, stack, i = {}, [], 0
    while i < len(text):
        c, top = text[i], stack[-1] if stack else ""
        if top == "`":
            if c == "\\":
                i += 1
            elif c == "`":
                stack.pop()
            elif text.startswith("${", i):
                stack.append("h")
                i += 1
        elif c in "\"'":
            while i + 1 < len(text) and text[i + 1] not in c + "\n":
                i += 2 if text[i + 1] == "\\" else 1
            i += 1
        elif text.startswith("//", i):
            while i + 1 < len(text) and text[i + 1] != "\n":
                i += 1
        elif text.startswith("/*", i):
            i = text.find("*/", i + 2) + 1
        elif c == "`":
            stack.append("`")
        elif c in "({[":
            if "`" not in stack:
                out[i] = len(stack)
            stack.append(c)
        elif c in ")}]":
            stack.pop()
            if "`" not in stack and not (c == "}" and top == "h"):
                out[i] = len(stack)
        i += 1
    return out


def random_source(r, depth=0):
    parts = []
    for _ in range(r.randrange(1, 6)):
        kind = r.randrange(9 if depth < 5 else 4)
        word = r.choice(["a", "foo", "x1", "$y", "é", "日本", "new"])
        if kind == 0:
            parts.append(word + r.choice([" = ", ", ", ";\n", " "]))
        elif kind == 1:
            parts.append(r.choice(["'s {'", '"\\"}("', "'\\\\'", '"//"']) + " ")
        elif kind == 2:
            parts.append(r.choice(["// it's {\n", "/* ` { \n */", "/** doc */"]))
        elif kind == 3:
            parts.append(r.choice(["1 + 2", "a / b", "x => y", "a < b"]) + ";")
        elif kind in (4, 5, 6):
            o, c = r.choice(["()", "{}", "[]"])
            parts.append(word + o + random_source(r, depth + 1) + c + " ")
        else:
            parts.append("`t } " + "${" + random_source(r, depth + 1) + "}" + r.choice([" { `", "\\` `", "$`"]) + ";")
    return "".join(parts)


def test_brackets_against_a_character_loop(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_LEXEMES", 7)  # many blocks
    r = random.Random(7)
    sources = [random_source(r) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(sources)), "id int, content string")
    x = L.lexed(F.col("content"), F.lit(False), depths=4)
    for row in d.select("id", "content", x.alias("x")).collect():
        want = plain_lexer(row.content)
        assert not row.x.suspect and len(row.x.src) == len(row.content)
        for k in range(4):
            shown = {i for i, c in enumerate(row.x[f"d{k}"]) if c in "(){}[]"}
            assert shown == {i for i, at in want.items() if k == 3 or at <= k}, row.content


def test_large_files_are_cut_and_give_the_same(spark, monkeypatch):
    r = random.Random(3)
    texts = []
    for i in range(3):
        parts = []
        for k in range(10):
            parts.append(random_source(r) + "\n")
            parts.append(r.choice([
                f"/** Doc\n * {k} */\nexport function f{k}(\n  a: string,\n  b = {k}\n): void {{\n  g(`x\n${{ h(\n) }}\n}}`);\n}}\n",
                f"export class C{k} {{\n  m(x: number): string {{\n    /* }}\n */ return `\n{{`;\n  }}\n}}\n",
                f"interface I{k} {{\n  a: number\n}}\nexport {{ I{k} }};\n",
                f"export type T{k} =\n  | 'a'\n  | {{\n    b: number\n  }}\n",
                f"export default\nfunction d{k}() {{}}\n",
            ]))
        texts.append(("\n".join(parts)) + ("}\n" if i == 2 else ""))
    views = "".join(f"export function V{k}() {{\n  return <p\n a={{ {k} }}>\n don't {{x ? <b>\n</b> :\n null}} </p>;\n}}\n" for k in range(3))
    files = make_files(spark, [(f"f{i}.ts", t) for i, t in enumerate(texts)] + [("views.tsx", views)])
    whole = sorted(map(str, Y.symbols_from(Y.declarations(Y.statements(files))).collect()))
    assert len(whole) > 20
    monkeypatch.setattr(L, "CHUNK", 400)
    cut = sorted(map(str, Y.symbols_from(Y.declarations(Y.statements(files))).collect()))
    assert cut == whole


def test_one_large_file_spreads_over_tasks(spark):
    text = "export function f(a: string): void { g(a); }\n" * 3_000
    files = make_files(spark, [("big.ts", text)])
    pieces = Y.statements(files)
    assert pieces.count() == 3_000 and pieces.select(F.countDistinct("pos")).first()[0] == 3_000
    chunks = Y.lexed_chunks(files, TK.FILE_KEYS)
    assert chunks.count() == len(text) // L.CHUNK + 1
    assert chunks.select(F.spark_partition_id()).distinct().count() > 1


def symbols(spark, *sources):
    files = make_files(spark, [(f"f{i}.ts" if isinstance(s, str) else s[0], s if isinstance(s, str) else s[1]) for i, s in enumerate(sources)])
    rows = Y.symbols_from(Y.extract(Y.source_candidates(files))).collect()
    return sorted(((r.path, r.ord, r.kind, r.name, r.params, r.return_type, r.suspect) for r in rows))


def test_exports_after_hard_literals(spark):
    got = symbols(
        spark,
        "const t = `x ${ `y } ${b}` } {`;\nexport function a(x: string): void {}",
        "if (ok) /[{(]/.test(x);\nexport function b(x: string): void {}",
        ("v.tsx", "const v = <p>don't {x}</p>;\nexport function C(p: Props): El { return <p>it's</p>; }\nexport enum E { A, B }"),
    )
    assert [(g[0], g[3], g[6]) for g in got] == [("f0.ts", "a", False), ("f1.ts", "b", False), ("v.tsx", "C", False), ("v.tsx", "E", False)]


def test_text_is_cut_from_the_source(spark):
    got = symbols(
        spark,
        'export type Q = "a\\"b" | \'two  blanks\' | `t ${x}`;',
        "export interface I { 'a  b': `x  y`; n /* c */ : /* d */ number\n  [k: string]: any; m(): void; readonly r?: A<B,\n C> }",
        "export enum E { 'x y' = 1, B, // last\n }",
        "export function f({ a, b }: P, [c]: [ number ] = [1], ...rest: T[]): { x: 'a;b' } { }",
    )
    assert [g[4] for g in got] == [
        '"a\\"b" | \'two  blanks\' | `t ${x}`', "'a  b': `x  y`; n: number; r?: A<B, C>", "'x y', B", "{a,b}: P, [c]: [ number ], rest: T[]",
    ]
    assert got[3][5] == "{ x: 'a;b' }"


def test_comparisons_are_not_generics(spark):
    got = symbols(
        spark,
        "export function f(a = b < c, d = 1) {}",
        "export function g(a = b < c, d = e > f, m: Map<string, Array<Set<number>>> = x): R<A, B> {}",
        "export function h(a = b < c && d > e, k = 'x') {}",
        "export function i<T extends (x: any) => void = {}>(a: T, b: (x: T) => void = (y) => {}, c?: T) {}",
        "export class K<T = A<B>> extends M<{ x: 1 }> implements N { p = a < b; q(x = 1 < 2, y: T<U, V>): W<X, Y> { return 1 > 2; } }",
    )
    assert [g[4] for g in got] == [
        "a: any, d: number", "a: any, d: any, m: Map<string, Array<Set<number>>>", "a: any, k: string",
        "a: T, b: (x: T) => void, c: T", "public q(x: any, y: T<U, V>): W<X, Y>",
    ]
    assert got[1][5] == "R<A, B>"


def test_suspect_files_are_marked(spark):
    files = make_files(spark, [("ok.ts", "export class A {}"), ("bad.ts", "export class B {}\n}"), ("lost.ts", "const x = {\nexport class C {}"), ("no.ts", "x {")])
    rows = Y.symbols_from(Y.extract(files))
    assert {(r.path, r.suspect) for r in rows.collect()} == {("ok.ts", False), ("bad.ts", True)}
    assert {(r.path, r.suspect) for r in K.skeleton_entries(rows).collect()} == {("ok.ts", False), ("bad.ts", True)}
    # Files whose exports are lost are in the list of suspects.
    assert {r.path for r in Y.suspects(Y.source_candidates(files)).collect()} == {"bad.ts", "lost.ts"}
    assert {(r.path, r.suspect) for r in TK.token_stats(files).collect()} == {("ok.ts", False), ("bad.ts", True), ("lost.ts", True), ("no.ts", True)}


def test_runs_of_words_and_signs_are_one_lexeme(spark):
    """The fold's work is a step for each lexeme: signs that change nothing have none."""
    d = spark.createDataFrame([("  a: b.c, d = e | f ? g : h;",), ("a => b-- / c*/ ${",), ("return x",)], "t string")
    rows = [r.x for r in d.select(L.lexemes(F.col("t")).alias("x")).collect()]
    assert len(rows[0]) == 1
    assert rows[1] == ["a ", "=>", " b", "--", " ", "/", " c", "*/", " ", "${"]
    assert rows[2] == ["return", " x"]


def test_a_step_is_a_look_up(spark):
    """A lexeme that changes nothing takes few expressions, in whatever mode it stands."""
    d = spark.createDataFrame([("x",)], "t string")
    plan = d.select(L.fold(F.transform(L.lexemes(F.col("t")), L.lexeme_class), F.lit(False))["mode"].alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 25


def test_marks_come_with_the_declarations(spark, monkeypatch):
    """With ``marks`` each file has one row without ``pos``, whether it declares something
    or not, also where it is cut into chunks; the other rows are the same."""
    files = make_files(spark, [("ok.ts", "export class A {}"), ("bad.ts", "export class B {}\n}"), ("lost.ts", "const x = {\nexport class C {}")])
    for chunk in (L.CHUNK, 12):
        monkeypatch.setattr(L, "CHUNK", chunk)
        x = Y.extract(files, marks=True)
        assert sorted((r.path, r.suspect) for r in x.where("pos is null").collect()) == [("bad.ts", True), ("lost.ts", True), ("ok.ts", False)]
        assert sorted(map(str, x.where("pos is not null").collect())) == sorted(map(str, Y.extract(files).collect()))


HARD = ["if", "while ", "return ", "in ", "(", ")", "[", "]", "{", "}", '"', "'", "`", "${", "//", "// c {\n", "/* { */", "/*", "*/", "/", "/ ", "/>", "</", "<>", "<b", "<p>", "*", "\\", "\\/", "\n", "\r", "\0", "\u00a0"]
EASY = ["a", "x1 ", "é", "😀", "{ a }", "(b)", "[c]", '"s{"', "'a\\\n'", "`t`", "`x ${y} }`", "`a ${ `b ${c}` } {`", "if (x) /[{(]/.test(y)", "x = /y/g", "a / b", "x[1] / 2", "A<B<c>>", "<T,>", "=>", "++", "-", ";", ","]


def test_patterns_tell_what_the_automaton_tells(spark):
    """Where patterns alone give a text's depths they are those of the fold, marks and all."""
    r = random.Random(11)
    soup = ["".join(r.choice(EASY * 2 + HARD) + r.choice(["", " "]) for _ in range(r.randrange(9))) for _ in range(4000)]
    sources = [c[1] for c in CASES] + ["*// c", "<bif / x", "A<b<c>>d", "for (;;) /x/return<> "] + soup + [random_source(r) for _ in range(200)]
    d = spark.createDataFrame([(s, jsx) for s in sources for jsx in (False, True)], "content string, jsx boolean").repartition(8)
    text, jsx = F.col("content"), F.col("jsx")
    x = d.select("content", "jsx", L._by_patterns(text, jsx, 4).alias("told"), L._by_modes(text, jsx, None, 4).alias("folded"))
    rows = x.where("told is not null").collect()
    assert len(rows) > 2000 and any(w.told.suspect for w in rows)
    assert [(w.content, w.jsx) for w in rows if w.told != w.folded] == []


def test_most_files_are_not_folded(spark):
    """Literals, comments, conditions before a regex, nested templates and a brace too
    many are told by patterns; of the generated files only those with JSX are folded."""
    from skimdex.sources import corpus as C

    files = C.code_corpus(spark, "/root/testdata/sf0.001")
    jsx = L.is_jsx(F.col("path"))
    told = files.select(jsx.alias("jsx"), L._by_patterns(F.col("content"), jsx, 3).isNotNull().alias("told")).groupBy("jsx").agg(F.min("told"), F.max("told"))
    assert sorted(told.collect()) == [(False, True, True), (True, False, False)]


JSX_SOUP = [
    "<b/>", '<p a="x">', "<p>", "</p>", "{", "}", "{x}", "{ok ? <b/> : null}", "{f(x)}", '{"s"}', "don't ", "text ", "= ", "(", ")", "return ", "? ", ": ", "\n", "\n  ", "// c =\n", "/* a = */",
    "<div x={y} {...z}>", "</div>", '<li key="a">t</li>', '<A.B c="d>" e={g => h(i)}/>', ",", "=> ", "> ", "a ", "&& ", "</", ";", "`t`", "x<y>", "/>", "$", "{`a`}", "<T,>", "[", "]", "/ ", "é",
]


def test_plain_elements_are_told_by_patterns(spark):
    """A JSX element after a sign is a literal to the patterns; where they tell a text it is
    as the fold has it, and other elements are left to the fold."""
    r = random.Random(3)
    soup = ["".join(r.choice(JSX_SOUP * 2 + EASY + HARD) for _ in range(r.randrange(12))) for _ in range(3000)]
    own = ["x = <p title=\"{\">don't {ready ? <b/> : null}</p>;\nexport class A {}", "f(\n  <b a='1'>{g(x)}</b>\n)", "x = <a/> / 2", "// y =\n <a/>", "x = <a b={`t`}/>;", "x = <a><></></a>;"]
    d = spark.createDataFrame([(s,) for s in own + soup], "content string").repartition(8)
    text, jsx = F.col("content"), F.lit(True)
    x = d.select("content", L._by_patterns(text, jsx, 4, elements=True).alias("told"), L._by_modes(text, jsx, None, 4).alias("folded")).where("told is not null")
    rows = x.collect()
    assert [w.content for w in rows if w.told != w.folded] == [] and len(rows) > 500
    told = {w.content for w in rows}
    assert [s in told for s in own] == [True, True, False, False, False, False]


def test_generated_elements_are_not_folded(spark):
    from skimdex.sources import corpus as C

    files = C.code_corpus(spark, "/root/testdata/sf0.001").where(L.is_jsx(F.col("path")))
    told = files.select(L._by_patterns(F.col("content"), F.lit(True), 3, elements=True).isNotNull().alias("told"))
    assert [tuple(r) for r in told.distinct().collect()] == [(True,)]


def test_brackets_deeper_than_the_patterns_are_folded(spark):
    deep = lambda n: "const x = " + "([{" * n + "1" + "}])" * n + ";\nexport class A { m(): void {} }\n"
    cases = [deep(2), deep(4), deep(5), deep(40), "f(]", "a }", "{ a", "x = { (a }", ""]
    d = spark.createDataFrame([(s,) for s in cases], "content string")
    x = d.select("content", L._by_patterns(F.col("content"), F.lit(False), 4).alias("told"), L.lexed(F.col("content"), F.lit(False), depths=4).alias("x"), L._by_modes(F.col("content"), F.lit(False), None, 4).alias("folded"))
    rows = {r.content: r for r in x.collect()}
    assert all(r.x == r.folded for r in rows.values())
    assert [rows[s].told is not None for s in cases] == [True, True, False, False, False, True, False, False, True]
