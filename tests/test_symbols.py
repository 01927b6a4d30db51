"""Signature extraction (FIXTURES F2-F6, E6, E7)."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import make_files
from skimdex.operators import skeleton as K
from skimdex.operators import symbols as Y

# Members of every visibility, a field, a static and an accessor-free body.
QUEUE = """export class Queue<T> {
  private items: T[] = [];
  protected readonly limit = 16;
  constructor(public readonly topic: string, private depth = 0) { this.depth = depth; }
  push(item: T, at: number): boolean { if (this.items.length > this.limit) { return false; } return true; }
  protected drain(each: (item: T) => void): void { this.items.forEach(each); }
  private reset() { this.items = []; }
}
"""

CAPS = "\n".join([
    "export interface Wide { " + "; ".join(f"f{i}: number" for i in range(9)) + " }",
    "export class Busy {",
    *[f"  m{i}(): void {{}}" for i in range(6)],
    "}",
    "export type Long = " + " | ".join(f'"value-{i:03d}"' for i in range(30)) + ";",
    "/** " + "word " * 40 + "*/",
    "export function documented(): void {}",
]) + "\n"

TRICKY = '''// export function commented() {}
const s = "export class InString {";
export function braces(a = "}{", b: string = 'it\\'s'): { ok: boolean } {
  return { ok: true };
}
export interface NoSemi {
  a: string
  b?: Map<string, number>
  c: { d: string }
}
function hidden() {}
'''


@pytest.fixture(scope="module")
def syms(spark):
    files = make_files(spark, [
        ("sample.ts", "export function scale(by: number, of: [number, number]): number[] { return of.map((x) => x * by); }\n"),
        ("class.ts", QUEUE),
        ("Panel.tsx", "export function Panel() { return <p>{\"(\"}</p>; }\n"),
        ("internal.ts", "const inner = () => { return [1, 2]; };\nfunction helper(a: number) { return a; }\n"),
        ("iface.ts", "export interface Span { from: number; to?: number; }\n"),
        ("caps.ts", CAPS),
        ("tricky.ts", TRICKY),
    ])
    rows = Y.extract_symbols(files).collect()
    out = {}
    for r in rows:
        out.setdefault(r.path, []).append(r)
    for v in out.values():
        v.sort(key=lambda r: r.ord)
    return out


def test_function(syms):
    (f,) = syms["sample.ts"]
    assert (f.kind, f.name, f.params, f.return_type) == ("function", "scale", "by: number, of: [number, number]", "number[]")


def test_class_visibility(syms):
    (c,) = syms["class.ts"]
    assert c.name == "Queue"
    assert "constructor(topic: string" in c.params
    assert "push(item: T, at: number): boolean" in c.params
    assert "protected drain(each: (item: T) => void): void" in c.params
    assert "reset" not in c.params


def test_tsx_and_unexported(syms):
    assert "Panel.tsx" in syms and syms["Panel.tsx"][0].return_type == "unknown"
    assert "internal.ts" not in syms


def test_caps(syms):
    by_kind = {r.kind: r for r in syms["caps.ts"]}
    assert by_kind["interface"].params.count(";") == 7          # 8 properties
    assert by_kind["class"].params.count(" | ") == 4            # 5 methods
    assert len(by_kind["type"].params) == 200
    assert len(by_kind["function"].docstring) == 120
    assert [r.kind for r in syms["caps.ts"]] == ["function", "class", "interface", "type"]


def test_tricky_lexing(syms):
    rows = syms["tricky.ts"]
    assert [r.name for r in rows] == ["braces", "NoSemi"]
    fn, iface = rows
    assert fn.params == "a: string, b: string" and fn.return_type == "{ ok: boolean }"
    assert iface.params == "a: string; b?: Map<string, number>; c: { d: string }"


def test_skeleton_text_and_symbols_only(spark, syms):
    files = make_files(spark, [("sample.ts", "export interface Span { from: number; to?: number; }\nexport function widen(span: Span): void {}\n")])
    x = Y.extract(Y.source_candidates(files))
    symbols = Y.symbols_from(x)
    entries = K.skeleton_entries(symbols, files)
    text = K.skeleton_text(entries).first().text
    assert text.startswith('\n"sample.ts" (0.1kb)\n')
    assert "  interface Span { from: number; to?: number }" in text
    body = K.symbols_only_text(x).first().symbols_body
    assert body.splitlines()[0] == "export function widen(span: Span): void"
    assert "export interface Span {\n  from: number;\n  to?: number\n}" in body


def test_skeleton_text_sink_and_totals(spark):
    import glob
    import os

    from skimdex.session import scratch_path

    files = make_files(spark, [
        ("b.ts", "export function b(): void {}\n"),
        ("a.ts", "export interface A { x: string; }\n"),
        ("none.ts", "const z = 1;\n"),
    ])
    symbols = Y.extract_symbols(files)
    text = K.skeleton_text(K.skeleton_entries(symbols, files))
    out = scratch_path(spark, "test-skeleton-text")
    K.write_skeleton_text(text, out)
    parts = sorted(glob.glob(os.path.join(out, "target_dir=*", "part-*.txt")))
    written = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert written.index('"a.ts"') < written.index('"b.ts"') and "none.ts" not in written
    blocks = [r.text for r in text.orderBy("path").collect()]
    totals = K.corpus_totals(text).first()
    assert totals.files_indexed == 2
    assert totals.skeleton_chars == len("\n".join(blocks))
    assert totals.skeleton_tokens == int(len("\n".join(blocks)) / 4 + 0.5)   # half up, as in JS


def test_lexer_survives_many_comment_lines_and_regex_literals(spark):
    from conftest import make_files
    from skimdex.operators import symbols as Y

    src = "// note\n" * 6000 + "const re = /[({]/;\nexport function pick(a: string): string { return a.replace(/https?:\\/\\//g, '{'); }\n// the end {"
    rows = Y.export_kind(Y.extract(Y.source_candidates(make_files(spark, [("/t/src/a.ts", src)]))), "function").collect()
    assert [r.name for r in rows] == ["pick"]


SHAPES = '''import { z } from './z';
export type { Foo } from './x';
export const type = 5;
export function fits<T extends (x: any) => void>(a: T, b: number): T { return a; }
export default class extends Base { run(): void {} }
export type Either = A
  | B
process.on('x', () => {})
export type Boxed<T = string> = { value: T
}
export interface Event {
  kind:
    | "open"
    | "shut"
  at: { x: number
  }
  tags: { a: string }[]
}
export class Panel {
  @Input('n') size: number = 1;
  @Listen('click', ['$event'])
  onClick(e: Event): void {}
  chain = build()
    .first()
    .last();
  *walk(): Iter { yield 1; }
  [Symbol.iterator](): Iter { return this.walk(); }
  wide(
    a: string,
    b: number
  ): void {}
  #hidden(): void {}
}
'''

LISTS = '''function inner(a: string): void {}
/** Listed. */
function listed(b: number): string { return ''; }
class Late {}
enum Own { A }
interface Same { x: number }
export { listed, inner as outer };
export { Same } from './same';
export default Late;
export function over(a: string): void;
export function over(a: number): void;
export function over(a: any): void { if (a) {} }
'''


@pytest.fixture(scope="module")
def shapes(spark):
    files = make_files(spark, [("shapes.ts", SHAPES), ("lists.ts", LISTS)])
    out = {}
    for r in sorted(Y.extract_symbols(files).collect(), key=lambda r: (r.path, r.ord)):
        out.setdefault(r.path, []).append(r)
    return out


def test_declaration_shapes(shapes):
    got = {(r.kind, r.name): (r.params, r.return_type) for r in shapes["shapes.ts"]}
    assert set(got) == {("function", "fits"), ("class", "AnonymousClass"), ("class", "Panel"),
                        ("interface", "Event"), ("type", "Either"), ("type", "Boxed")}
    assert got["function", "fits"] == ("a: T, b: number", "T")
    assert got["type", "Either"][0] == "A | B"
    assert got["type", "Boxed"][0] == "{ value: T }"


def test_member_shapes(shapes):
    got = {r.name: r.params for r in shapes["shapes.ts"]}
    assert got["Event"] == 'kind: | "open" | "shut"; at: { x: number }; tags: { a: string }[]'
    assert got["Panel"].split(" | ") == [
        "public onClick(e: Event): void", "public walk(): Iter", "public [Symbol.iterator](): Iter",
        "public wide(a: string, b: number): void", "public #hidden(): void",
    ]


def test_export_lists_defaults_and_overloads(shapes):
    got = [(r.kind, r.name, r.params, r.docstring) for r in shapes["lists.ts"]]
    assert got == [
        ("function", "inner", "a: string", None), ("function", "listed", "b: number", "Listed."),
        ("function", "over", "a: any", None), ("class", "Late", "", None),
    ]


def test_corpus_rows_are_the_whole_text(spark):
    paths = [f"d{i % 7}/f{i}.ts" for i in range(60)]
    files = make_files(spark, [(p, f"export function f{i}(a: string): void {{}}\nexport enum É{i} {{ A }}\n") for i, p in enumerate(paths)])
    text = K.skeleton_text(K.skeleton_entries(Y.extract_symbols(files), files))
    whole = "\n".join(r.text for r in sorted(text.collect(), key=lambda r: r.path))
    rows = sorted(K.corpus_rows(text).collect(), key=lambda r: r.block_no)
    assert [r.block_no for r in rows] == list(range(1, 61)) and "\n".join(r.text for r in rows) == whole
    assert all(whole[r.char_offset : r.char_offset + len(r.text)] == r.text for r in rows)
    assert len(whole) == K.corpus_totals(text).first().skeleton_chars
    assert K.corpus_rows(text.limit(0)).collect() == []


def test_optional_indexes(spark):
    files = make_files(spark, [("a.ts", 'export function f(a: import("/x/y").Z<import("b").W>): import("c").V {}\nexport enum A { B }\nexport enum C { D }')])
    rows = Y.extract_symbols(files)
    f = Y.compact_types(rows).where("name = 'f'").first()
    assert (f.params, f.return_type) == ("a: Z<W>", "V")
    assert [r.name for r in Y.capped_exports(rows, 2).orderBy("ord").collect()] == ["f", "A"]
    assert {(r.kind, r.name) for r in Y.minimal_index(files).collect()} == {("function", "f"), ("enum", "A"), ("enum", "C")}


def test_constants_on_request(spark):
    src = """export const A = 5
export const b: Map<string, number> = new Map();
export declare const c: string
export const f = (x: number) => { return "const z = 1"; }
export const enum E { X }
const hidden = 1;
export const { d, e } = obj;
export const s = 'a;b', t = 2;
export function g() {}
"""
    files = make_files(spark, [("a.ts", src)])
    got = {r.name: r.params for r in Y.export_constants(files).collect()}
    assert got == {"A": "number", "b": "Map<string, number>", "c": "string", "f": "any", "s": "any"}
    assert {r.name for r in Y.extract_symbols(files).collect()} == {"E", "g"}


@pytest.mark.parametrize("kind, texts", [("class", ["d1", "d2", "src"]), ("interface", ["d1", "src"])])
def test_a_body_is_cut_from_each_text_once(spark, kind, texts):
    """Not once more for each member, or the work grows with members times length."""
    made = str(Y._body_members(kind, F.col("lb"), F.col("rb")))
    assert {t: len(re.findall(rf"substring\({t}, ", made)) for t in texts} == dict.fromkeys(texts, 1)


def test_names_and_types_behind_type_parameters_and_blanks(spark):
    text = (
        "export class A {\n  constructor(private x = 1, public readonly y?: Map<string, number>, z = true) {}\n"
        "  one <T, U extends X<T>> (a: T, b = 'q', ...rest: U[]): Promise<T> { return a; }\n  two? (): void;\n"
        "  'quoted name' (a = f(1)) { }\n  [key(1)] (n: number): string { return ''; }\n  private gone(): void {}\n"
        "  @Deco('x, y') protected last(@In() { a, b }: P): { c: number } { return {}; }\n}\n"
    )
    [got] = Y.extract_symbols(make_files(spark, [("a.ts", text)])).collect()
    assert got.params == (
        "constructor(x: number, y: Map<string, number>, z: boolean) | public one(a: T, b: string, rest: U[]): Promise<T> | public two(): void | "
        "public 'quoted name'(a: any): unknown | public [key(1)](n: number): string | protected last({a,b}: P): { c: number }"
    )
