"""Grammars against valid and invalid snippets of each language; the operator's defined cases."""

import pytest

from millrace.llm import grammars, parsing

VALID = {
    "rust": [
        "", "// only a comment", "\ufefffn main() {}\r\n", "#![allow(dead_code)]\nmod a { pub(crate) fn f() {} }",
        "use std::{collections::{HashMap, *}, io::self as i}; pub use crate::x::Y as _;",
        "fn f<'a, T: Clone + 'a, const N: usize>(&'a mut self, x: &[T; N], mut y: impl Fn(u8) -> u8) -> Result<Vec<Vec<T>>, Box<dyn E + Send>> where T: Copy, for<'b> F: Fn(&'b u8) {}",
        "fn f() { let x = if a { 1 } else { 2 }; match x { 0 | 1 if y => {}, 2..=5 => (), Some(ref n @ 1..) => { g() } _ => return, } }",
        "fn f() { for (i, x) in v.iter().enumerate() { if let Some(x) = g() && y { break 'a; } } 'a: loop { continue 'a } }",
        "fn f() { let s = S { a: 1, b, ..Default::default() }; if x == (S { a: 1 }) {} let c = |x: u8, y| -> u8 { x + y }; v.sort_by(|a, b| b.cmp(a)); }",
        "struct A; struct B(pub u8, String); #[derive(Debug)] pub struct C<T> { pub a: T, b: Option<&'static str> } enum E { A, B(u8), C { x: u8 } = 3 }",
        "impl<T> Tr for X<T> { type O = u8; const K: u8 = 1; fn f(self: Box<Self>) -> Self::O { <T as Q>::z(1) } } trait Q: A + B { fn g(&self) {} }",
        "macro_rules! m { ($a:expr) => { $a + 1 }; } fn f() { println!(\"{}\", 1); vec![1; 3]; m! { x } let y = x as u64 << 2; z = a < b && c > d; }",
        "fn f() -> usize { let c = 'x'; let q = '\\''; let r = r#\"a \" b\"#; b\"x\"; 1_000u64 + 0xff - 1.5e3 as usize; a..b; ..; x?.y.await; &mut z; *p = 1 }",
        "fn f() { let v = (1..2).rev().collect::<Vec<_>>(); let Some(x) = y else { return }; unsafe { *p } /* a /* b */ c */ }",
        "async fn f() { async move { g().await? }; move || x; return; } extern \"C\" { fn k(x: *const u8, ...); } static mut X: u8 = 1;",
        "fn f(x: &dyn Fn(u8)) { while let Some(_) = s.pop() {} let a: [u8; 4] = [0; 4]; let t = (1, 2.0).0; x.0.1; }",
        "fn f() { match t { (a, b) if a < b => a, [x, .., y] => x, &Foo::Bar(-1) => 1, 'a'..='z' => 2, \"s\" => 3, _ => 0 }; }",
    ],
    "go": [
        "", "// c\n", "package a", "package a\nimport (\n\t\"fmt\"\n\t. \"x\"\n\t_ \"y\"\n)\n",
        "package a\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\treturn 1, nil\n}\n",
        "package a\nfunc f() {\n\tif x, err := g(); err != nil {\n\t} else if y {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t}\n\tfor range 3 {\n\t}\n\tfor {\n\t\tbreak\n\t}\n}\n",
        "package a\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, []string:\n\tcase nil:\n\t\tfallthrough\n\tdefault:\n\t}\n\tswitch {\n\tcase a > b:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\tdefault:\n\t}\n}\n",
        "package a\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nvar p = &T{A: 1, B: []T{{1}, {2}}}\nconst (\n\tA = iota\n\tB\n)\n",
        "package a\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*T\n\tpkg.U\n}\ntype I interface {\n\tF(int) error\n\t~int | string\n}\ntype G[T any, K comparable] struct{ x T }\ntype F func(a int) (b string)\n",
        "package a\nfunc Map[T, U any](x []T, f func(T) U) []U { return Map[int, string](x, func(a int) string { return \"\" }) }\n",
        "package a\nfunc f() {\n\tdefer func() {\n\t}()\n\tgo g(x...)\n\tL:\n\tfor {\n\t\tcontinue L\n\t}\n\tx := []byte(`raw \" {`)\n\ty := x[1:2:3]\n\tz := '\\''\n\tc <- <-d\n\ta, b = b, a\n\tx.y.(T).z[i]++\n\tvar e [3]int\n\tif (T{}) == x {\n\t}\n}\n",
        "package a; func f() { x := struct{ a int }{1}; _ = x; ch := make(chan<- int, 3); _ = ch }",
    ],
    "javascript": [
        "", "#!/usr/bin/env node\n", "import a, { b as c, default as d } from 'm'; import * as n from \"m\"; import 'x'\nexport * from 'y'; export { a as default, b }; export default class {}",
        "const f = async (a, { b, ...c } = {}, [d, , e] = []) => { await a; for await (const x of y) {} };\nlet g = x => ({ ...x, [k]: 1, get a() { return 1 }, async *m() { yield* z } })",
        "class A extends B.C { #p = 1; static x; static { this.y = 2 } constructor() { super(); } get v() { return this.#p } async m() {} *g() {} static async s() {} }",
        "if (a) b\nelse c\nfor (var i = 0, n = 3; i < n; i++) {}\nfor (const k in o) if (!k) continue\ndo x--; while (x > 0)\nlbl: while (1) { break lbl }\nswitch (x) { case 1: y(); break; default: z() }",
        "try { a } catch { b } finally { c }\nthrow new Error(`x ${a + `${b}`} y`)", "const r = /[/({]+/g.test(s), q = a / b / c;\nconst s2 = String(x).replace(/[({]+/g, 'y');",
        "a ??= b; c ||= d?.[e]?.f?.(g); h = i ? j : k; (function () {})(); !function (a) { return a }(1); var x = function* () {}; delete a.b, void 0",
        "try{a=JSON.parse(\"[1]\")}catch(b){}var c=1,d=function(e){return e?e.f(1):void 0};if(typeof g==\"undefined\")var h=[1,!0,!1];",
        "x = a\n++b\nlet y = 1_000n + 0xff + .5e3; of = async; async = get; const { default: z = 1 } = w; tag`a${1}b`; import('x').then(m => m); import.meta.url",
    ],
    "typescript": [
        "type A<T extends B = C> = { readonly [K in keyof T]?: T[K] } | ((x: number, ...y: string[]) => void) | `a${string}` | typeof x[number];\ninterface I extends J<K>, L { (a: b): c; new (): d; m?(x: y): z; [k: string]: any; readonly q: number }",
        "enum E { A = 1, B = 'x', C }\ndeclare module 'm' { export const x: number; }\nnamespace N.M { export function f(): void }\nabstract class C<T> implements I, J { private readonly x!: number = 1; constructor(private a: string, public b?: number) { super() } abstract m(): void; static async f<U>(this: C<U>, x?: U): Promise<U> { return x as U } get y(): number { return 1 } declare z: string }",
        "const f = async <T,>(x: T): Promise<Map<string, Array<T>>> => { return x! as unknown as any; };\nlet a = <any>b; let c = d satisfies E; function g(x: unknown): x is string { return typeof x === 'string' } function h(x): asserts x {}",
        "import type { A, B } from './x'; import { type C, D } from './y'; export type { A }; import x = require('y'); export = x;",
        "export function over(a: string): void;\nexport function over(a: any) {}\nconst t: [a: number, b?: string, ...rest: boolean[]] = [1];\nlet u: A extends infer B ? B : never; f<string>(x); new Map<string, number[]>(); a < b; c > d;",
        "class A { count: number = 1;\n  folder = 2\n  async join(x: number[], y: number[]): Promise<Map<string, number>> {\n  }\n}\nlet v: unique symbol; for (const x of <any>y) {}",
    ],
    "tsx": [
        "const x = <div className=\"a\" {...p} onClick={() => { f('}') }}>it's {y} <b/> <></> {/* c */}</div>;\nfunction F<T,>(p: T) { return (\n<A.B<X> />\n) }".replace("<A.B<X> />", "<A.B />"),
        "export const f = <T extends object>(a: T) => a < b && <p>{a ? <i>x</i> : null}</p>;",
    ],
    "python": ["", "# c", "\ufeffx = 1\r\n", "match x:\n    case [1, *_]: pass\n", "async def f[T](x: T, /, *, y=1) -> T:\n    return await x\n", "print(f'{x!r:>{w}} {\"a\"}')"],
}

INVALID = {
    "rust": ["fn f( {", "fn f() {", "<<<<<<< HEAD\nfn f() {}", "fn f() }", "let x = 1;", "fn f() { let x := 1; }", "fn f() { \"abc }", "const x = 'it';", "def f():\n    pass", "fn f() { a b }", "# title\ntext", "/* a"],
    "go": ["func f() {}", "package a\nfunc f() {", "package a\nfunc f( {\n}", "package a\n<<<<<<< HEAD\n", "package a\nvar x = \"abc\n", "package a\n)\nfunc f() {}\n", "package a\nfunc f() { if x { }", "package a\nimport \"x\" \"y\"\n", "package a\nfunc f() { x := T{ }"],
    "javascript": ["function (x {", "const x = 'it;", "if (x {", "export class A {", "class A { x: number = 1; }", "function f(a: number) {}", "=======\nx", "return 1", "let x = ;", "a b", "for (;;", "`abc", "import { a from 'b'", "const x: string = 1", "def f():\n  pass", "interface A {}\n"],
    "typescript": ["function f(x: ) {}", "type A = ;", "class A {\n  m(): Promise<Map<string, number>> {\n}", "pub fn f() {}", "return 1;", "const a = (x: number => x;", "[...truncated by the exporter...]", "<<<<<<< ours\nlet a\n"],
    "tsx": ["const x = <div>", "const x = <div></span>;", "const y = <a b={1}</a>;"],
    "python": ["def f(\n", "print 'x'", "x = 'abc", "def f()\n    pass", "  x = 1\n y = 2", "return 1", "<<<<<<< HEAD\nx = 1\n", "if x:\npass"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    at = grammars.failure(language, text)
    assert at is None, text[max(at - 30, 0) : at] + " >>> " + text[at : at + 40]


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert grammars.failure(language, text) is not None


def test_furthest_failure_and_causes():
    assert parsing.judge("a.rs", "fn f() {\n  let x = 1;\n")[1:] == (False, 22, 2, "truncated")
    assert parsing.judge("a.py", "x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n")[4] == "conflict_markers"
    assert parsing.judge("a.ts", "package a\n\nfunc f() {\n}\n")[4] == "other_language"
    assert parsing.judge("a.js", "const a = 1;\nconst b = = 2;\n")[1:4] == (False, 23, 1)


def test_not_judged():
    assert parsing.judge("a.yml", ": : :") is None
    assert parsing.judge("a.rs", None) is None
    assert parsing.judge(None, "x") is None


def test_operator(spark):
    rows = [(1, 1, "a.py", "x = ("), (1, 1, "a.py", "x = ("), (2, 1, "b.py", ""), (3, 1, "c.go", None), (4, 2, "d.rs", "fn f( {"), (5, 2, "e.toml", "x = ("), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "file_id long, repo_id long, file_path string, content string, language string")
    got = parsing.judged(df)
    assert sorted(r.file_id for r in got.where("not valid").select("file_id").distinct().collect()) == [1, 4]
    found = {(r.repo_id, r.language): (r.files, r.invalid, r.rate) for r in parsing.rates(got).collect()}
    assert found == {(1, "python"): (2, 1, 0.5), (2, "rust"): (1, 1, 1.0)}
    assert parsing.judged(df.limit(0)).count() == 0


def test_deep_nesting_is_not_invalid():
    from millrace.llm import grammars

    for language, text in (("javascript", "x = " + "(" * 1500 + "1" + ")" * 1500 + ";\n"), ("go", "package a\n\nvar x = " + "(" * 1500 + "1" + ")" * 1500 + "\n"), ("rust", "fn f() { let x = " + "(" * 1500 + "1" + ")" * 1500 + "; }\n")):
        assert grammars.failure(language, text) is None
        assert grammars.failure(language, text.replace("1", "1 1", 1)) is not None
    assert parsing.judge("a.py", "x = " + "(" * 5000 + "1" + ")" * 5000) == ("python", None, None, None, "too_deep")
