"""Lexical checks against the syntax tree of the snippets that parse."""

import ast
import time
from collections import Counter

from conftest import rows
from siftline.operators import linescan, structure
from siftline.plans import review
from siftline.plans.views import SNIPPETS

PROGRAMS = [s for s in SNIPPETS] + [
    "for a in b:\n    while c:\n        d[a] += 1\n    e.f += 2\n    g += 3\nh.i += 4\n",
    "while x:\n    if y:\n        z.w += 1\n    # note\n\n    q['k'] += 2\nr.s += 1\n",
    "for k in ks: acc.total += k\n",
    "x = [i for i in y]\nobj.n += 1\n",
    "def f():\n    global a, b\n    assert a; assert b\n    return eval(a.eval(exec(b)))\n",
    "Secret_Key = 'v'\nmy_token = ''\npassword = f'{x}'\nkeys = r'abc'  # c\na.password = 'x'\n",
    "x = 'eval(1)'  # exec(2)\n__import__('os').system('ls')\nre.compile('a')\n",
]


def parsed():
    for i, p in enumerate(PROGRAMS):
        try:
            yield f"f{i}.py", ast.parse(p)
        except SyntaxError:
            continue


def expected(check):
    found = Counter()
    for name, tree in parsed():
        for node in ast.walk(tree):
            for row in check(node):
                found[(name, *row)] += 1
    return found


def run(corpus, scan, *columns):
    names = {name for name, _ in parsed()}
    found = rows(scan(corpus(*PROGRAMS)), "file", "line_number", *columns)
    return Counter(r for r in found if r[0] in names)


def test_dangerous_calls(corpus):
    def check(node):
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else getattr(f, "attr", None)
            if name in structure.DANGEROUS_CALLS:
                yield node.lineno, f"Use of {name}() can be dangerous"

    assert run(corpus, structure.dangerous_calls, "message") == expected(check)


def test_code_execution(corpus):
    def check(node):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("eval", "exec"):
            yield node.lineno, f"Code Injection ({node.func.id})"

    assert run(corpus, structure.code_execution, "type") == expected(check)


def test_asserts_and_globals(corpus):
    assert run(corpus, structure.assert_statements) == expected(
        lambda n: [(n.lineno,)] if isinstance(n, ast.Assert) else []
    )
    assert run(corpus, structure.global_statements) == expected(
        lambda n: [(n.lineno,)] if isinstance(n, ast.Global) else []
    )


def test_secret_assignments(corpus):
    def check(node):
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name) and any(w in t.id.lower() for w in structure.SENSITIVE_WORDS):
                    if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and node.value.value:
                        yield (node.lineno,)

    got = run(corpus, structure.secret_assignments)
    want = expected(check)
    # Two statements on one line: only the first one is looked at.
    assert got == want


def test_loop_concatenation_counts_enclosing_loops(corpus):
    def check(node):
        if isinstance(node, (ast.For, ast.While)):
            for inner in ast.walk(node):
                if isinstance(inner, ast.AugAssign) and isinstance(inner.op, ast.Add):
                    if isinstance(inner.target, (ast.Subscript, ast.Attribute)):
                        if not any(inner in ast.walk(o) for o in node.orelse):
                            yield (inner.lineno,)

    assert run(corpus, structure.loop_concatenations) == expected(check)


def test_todo_comments(corpus):
    found = rows(
        structure.todo_comments(corpus("x = 1 # todo: a # b \n# nothing\n'TODO'\n#Fixme\ny # HACKY")),
        "line_number", "message",
    )
    assert found == [(1, "Found comment: todo: a # b"), (4, "Found comment: Fixme"), (5, "Found comment: HACKY")]


def test_empty_except(corpus):
    code = "try:\n    pass\nexcept:\n    pass\ntry:\n    x\nexcept E as e:\n    # why\n    y\nexcept F:\n    raise\n"
    assert rows(structure.empty_except(corpus(code)), "line_number", "type") == [(3, "code_smell"), (7, "code_smell")]
    assert rows(structure.empty_except_bug(corpus(code)), "line_number", "cwe_id") == [(3, "CWE-391"), (7, "CWE-391")]
    assert structure.empty_except(corpus("except:")).isEmpty()


def test_review_merges_and_deduplicates(corpus):
    found = review.review(corpus("eval(x)\n# TODO a", "password = 'longpassword'"))
    keys = rows(found, "file", "line_number", "message")
    assert len(keys) == len(set(keys))
    assert ("f0.py", 1, "Use of eval() can be dangerous") in keys
    assert ("f0.py", 1, "eval() executes arbitrary code") in keys
    stages = {r.stage for r in found.select("stage").distinct().collect()}
    assert stages == {"static", "codex-bug"}
    assert review.review(corpus("x = 1")).isEmpty()


def test_loop_depths_reach_over_runs_of_lines(spark):
    lines = ["for a in b:", "    while c:"] + [f"        x[{i}] += 1" for i in range(700)] + ["    y.z += 1", "w[0] += 1"]
    corpus = spark.createDataFrame([("f.py", "\n".join(lines), "python")], "path string, content string, language string")
    found = linescan.scan(corpus, (structure.LOOPS,)).groupBy("line_number").count().collect()
    assert {r["line_number"]: r["count"] for r in found} == {i: 2 for i in range(3, 703)} | {703: 1}


def test_loop_depths_of_a_long_file_are_linear(spark):
    block = ["for a in b:", "    x.n += 1", "    while c:", "        y[0] += a", "z.n += 1", ""]

    def seconds(lines):
        text = "\n".join(block * (lines // len(block)))
        corpus = spark.createDataFrame([("f.py", text, "python")], "path string, content string, language string")
        begin = time.monotonic()
        found = linescan.scan(corpus, (structure.LOOPS,)).count()
        assert found == lines // len(block) * 3
        return time.monotonic() - begin

    seconds(60_000)
    half = min(seconds(60_000) for _ in range(2))
    assert seconds(120_000) <= 2.2 * half + 0.5
