import ast
import json

import pytest

from prism.llm.derivatives import Grammar
from prism.llm.syntax import check, check_files, rates

VALID = {
    "python": [
        "", "x = 1\n", "def f(a, /, b: int = 2, *c, d, **e) -> int:\n    return a if b else c[1:2, ::3]\n", "class A(B, metaclass=C):\n    x: int = 1\n    @p(1)\n    async def f(self):\n        async with a as b, c:\n            await d\n",
        "try:\n    pass\nexcept* E as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a, b\n", "match a:\n    case {'k': [1, *r], **z} if q:\n        pass\n    case A(x=1) | B():\n        pass\n", "f'{x!r}' 'y' r\"\"\"z\n'\"\"\"\n",
        "for i, in z: print(i); continue\nelse: pass\n", "x = [y for y in z if y] + {a: b for a, b in c}\nw = lambda *a, b=1: (yield)\n", "if (n := 3) > 2: pass\nelif not a in b: pass\n", "x = \\\n  1\n\n# c\n", "@a.b\ndef f(): ...\n", "print(*a, **b, c=1)\n", "global x\nx += 1; y @= 2\n",
    ],
    "javascript": [
        "", "import a, { b as c } from './x.js';\nexport default function () {}\n", "const f = async ({ a, b = 1, ...c }, [d]) => ({ d });\n", "let a = 1\nlet b = a\n++b\n", "for (const x of y) { if (!x) continue; else break }\n", "class A extends (B, C) { #p = 1; static { } get x() { return this.#p } async *g() { yield* h() } 'q'() {} }\n",
        "a = b / c / d; r = /[/\"]x/g.test(s) ? `a${`n${1}`}b` : null\n", "label: while (true) { do x++; while (x) }\n", "switch (a) { case 1: default: b() }\ntry { } catch { } finally { }\n", "x = { a, get b() { return 1 }, ['c']: 2, async d() {}, ...e, if: 3 }\n", "new A().b?.[c]?.(d)\nif (a) b\nelse c\n", "return_ = (a, b) => a ** b ?? c\n/* x */\n",
        "export { a as default, b }; export * as n from 'm'\n", "var s = 'it\\'s', t = \"\\\n\"\n",
    ],
    "typescript": [
        "interface A<T extends B = C> { readonly x?: string; [k: string]: number; (a: T): void; new (): A; m?<U>(u: U): u is X }\n", "type F = (a: string, ...b: number[]) => Promise<Map<string, Array<number>>>;\n", "export abstract class A<T> extends B<T> implements C, D { private readonly x!: string; constructor(private a: number, b?: string) { super() } abstract f(): void; static g<T>(this: A, x: T = 1 as any): x is T { return x! } }\n",
        "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nnamespace N.M { let z }\n", "let a = <T,>(x: T) => x, b = f<string>(c) satisfies D;\n", "import type { A } from './a'; export type { B } from './b';\n", "type M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };\nlet t: [a: string, b?: number] | `x${string}`;\n", "function f(a: number): string\nfunction f(a: any) { return a < 1 || a > 2 }\n", "const x = a as unknown as B[];\n",
    ],
    "php": [
        "", "plain text", "<?php\nnamespace A\\B;\nuse C\\{D, E as F};\nconst X = 1;\nabstract class G extends H implements I, J { use K; public const int L = 2; private ?array $m = null; public function __construct(private readonly int|string $n = 1, ...$o) { parent::__construct(); } abstract function p(): static; }\n",
        "<?php if ($a): ?>\n<b><?= $b ?></b>\n<?php endif; foreach ($c as $k => [$d, $e]) { continue 2; }\n", "<?php $f = fn(int &$x) => $x ?? throw new E(\"a {$b['c']->d()} $e ${f}\"); $g = static function () use (&$h): void {};\n", "<?php echo <<<EOT\n  x {$y}\n  EOT . 'z';\n", "<?php enum S: string { case A = 'a'; public static function f(): self { return match(true) { 1, 2 => self::A, default => null }; } }\n",
        "<?php #[A(1)] function f() { yield from g(); list('a' => $x) = $y; return $x?->y::Z[0] <=> (int) $w; }\n// c ?>\ntext", "<?php $a = $b . 'c' ?: new class(1) extends D {};\n", "<?php try { unset($a[1]); } catch (A | B $e) { goto x; } finally { } x: exit;\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "[]", ' "x" '],
}
INVALID = {
    "python": ["def f(:\n    pass\n", "x = (1,\n", "if a:\nb\n", "<<<<<<< HEAD\nx = 1\n", "  x = 1\n", "x = 'a\n", "class A\n", "return = 1\n", "x = [1, 2}\n", '"""open\n'],
    "javascript": ["function f( {\n", "const x = `a${b\n", "import { a  from './b.js';\n", "let a: string = 1\n", "x = {a: 1,, b}\n", "<!DOCTYPE html>\n", "=======\n", '{"a": 1, "b": 2}\n', "if (a {\n}\n", "/* open", "def f():\n  pass\n", "a b\n"],
    "typescript": ["function f(a: ): void {}\n", "class A { f(): void {\n", "interface A { x: string\n", "let x: Map<string, number = 1;\n", "<<<<<<< ours\n"],
    "php": ["<?php function f( { }\n", "<?php $a = 'b;\n", "<?php if ($a) {\n", "<?php\n<<<<<<< HEAD\n$x = 1;\n", '<?php $a = "b {$c";\n', "<?php class { }\n", "<?php foreach ($a $b) {}\n"],
    "json": ["{'a': 1}", '{"a": 1,}', "[1 2]", "{", "NaN", '"a\nb"', "01", '{"a": 1} x'],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    if language == "json" or text.strip():
        assert check(text, language) is None
    if language == "python":
        ast.parse(text)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert check(text, language) is not None
    if language in ("python", "json"):
        with pytest.raises((SyntaxError, ValueError)):
            ast.parse(text) if language == "python" else json.loads(text, parse_constant=lambda x: 1 / 0 if False else (_ for _ in ()).throw(ValueError(x)))


def test_the_failing_token_and_the_cut():
    assert check("x = (1 2)\n", "python") == ("token", 7)
    assert check("function f() { return 1", "javascript") == ("truncated", 23)


def test_every_cut_of_a_text_fails_or_parses():
    text = VALID["javascript"][5]
    for i in range(len(text)):
        check(text[:i], "javascript")


def test_grammars_with_left_recursion_are_refused():
    g = Grammar("a = a 'x' | 'y' ;", "a")
    with pytest.raises(ValueError):
        g.step(g.start, "x")
    with pytest.raises(ValueError):
        Grammar("a = b ;", "a")


def test_files(spark):
    texts = spark.createDataFrame(
        [("r/a.py", "x = 1\n", "k"), ("r/a.py", "x = 1\n", "k"), ("r/b.py", "x = (\n", "k"), ("r/c.json", "", "k"), ("r/d.js", "", "k"), ("r/e.md", "# x", "k"), ("r/f.py", None, "k"), ("r/g.txt", "let x: string = 'a'", "k"), ("r/h.py", "x = 1\n" * 20000, "k")],
        "path string, content string, language string",
    )
    files = spark.createDataFrame([("r/a.py", "Python", "r", 1), ("r/b.py", "PYTHON ", "r", 1), ("r/g.txt", "TypeScript", "r", 2), ("r/g.txt", "python", "r", 1), (None, None, None, None)], "path string, language string, repo string, s long").selectExpr("*", "timestamp_seconds(s) as seen_at")
    got = {r["path"]: r for r in check_files(texts, files).collect()}
    assert {k: v["valid"] for k, v in got.items()} == {"r/a.py": True, "r/b.py": False, "r/c.json": False, "r/d.js": True, "r/e.md": None, "r/g.txt": True, "r/h.py": True}
    assert got["r/b.py"]["error"] == "truncated"
    assert {(r["repo"], r["language"]): (r["files"], r["invalid"]) for r in rates(check_files(texts, files)).collect()}["r", "python"] == (2, 1)
    assert check_files(texts.limit(0), files.limit(0)).count() == 0
