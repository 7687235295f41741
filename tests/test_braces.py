"""Blocks of brace languages against a plain walk over the characters."""

import random

import pytest

from quarry.operators import braces

GO = """package main

import ("fmt")

// { comment
type T struct {
  a int
}

func (t *T) Run(x int) error {
  for i := 0; i < 3; i++ {
    if x > 1 { fmt.Println("}") } else {
      go func() { x++ }()
    }
  }
  s := `{
`
  return nil
}
"""
JS = """const f = async (a) => {
  each(a, function named(x) { return x; });
};
class A extends B {
  get(k) { return {a: 1}; }
  /* } */
  static async put(k, v) {
    for (let i = 0; i < 2; i++) { while (true) { break; } }
"""
JAVA = """public class A
    implements B, C
{
  @Override
  public int run(int a,
                 int b) throws E
  {
    String s = "\\"}{";
    return a;
  }
}
"""
RUST = "impl T {\n  fn new(x: u8) -> Self {\n    match x { 0 => 1, _ => 2 }\n  }\n}\n}\n"


def told(spark, **codes):
    rows = [(k, v) for k, v in codes.items()]
    return sorted((tuple(r) for r in braces.units(spark.createDataFrame(rows, "file_path string, content string")).collect()), key=repr)


def test_languages(spark):
    found = told(spark, go=GO, js=JS, java=JAVA, rust=RUST)
    at = lambda k: sorted((r[1:] for r in found if r[0] == k), key=lambda r: (r[2], r[4]))
    assert at("go") == [("class", "T", 6, 8, 0), ("function", "Run", 10, 19, 0), ("control", None, 11, 15, 1), ("control", None, 12, 12, 2), ("control", None, 12, 14, 2), ("function", None, 13, 13, 3)]
    assert at("js") == [("function", "f", 1, 3, 0), ("function", "named", 2, 2, 1), ("class", "A", 4, 8, 0), ("function", "get", 5, 5, 1), ("block", None, 5, 5, 2), ("function", "put", 7, 8, 1), ("control", None, 8, 8, 2), ("control", None, 8, 8, 3)]
    assert at("java") == [("class", "A", 1, 11, 0), ("function", "run", 5, 10, 1)]
    assert at("rust") == [("class", "T", 1, 5, 0), ("function", "new", 2, 4, 1), ("control", None, 3, 3, 2)]


def plain(code):
    """(line of the brace, end line, depth) of each block, by a lexer with a state and a stack."""
    out, stack, line, i, extra = [], [], 1, 0, 0
    last = code.count("\n") + (not code.endswith("\n"))
    while i < len(code):
        c = code[i]
        if code[i : i + 2] == "//":
            while i < len(code) and code[i] != "\n":
                i += 1
            continue
        if code[i : i + 2] == "/*":
            end = code.find("*/", i + 2)
            end = len(code) if end < 0 else end + 2
            line += code.count("\n", i, end)
            i = end
            continue
        if c in "\"'`":
            i += 1
            while i < len(code) and code[i] != c and (c == "`" or code[i] != "\n"):
                if code[i] == "\\" and i + 1 < len(code):
                    line += code[i + 1] == "\n"
                    i += 1
                else:
                    line += code[i] == "\n"
                i += 1
            if i < len(code) and code[i] == c:
                i += 1
            continue
        if c == "\n":
            line += 1
        elif c == "{":
            stack.append((line, len(stack) - extra))
        elif c == "}":
            if stack:
                start, depth = stack.pop()
                out.append((start, line, depth))
            else:
                extra += 1  # depths go below zero
        i += 1
    return sorted(out + [(start, last, depth) for start, depth in stack])


@pytest.mark.parametrize("seed", range(3))
def test_ends_on_random_code(spark, seed):
    rng = random.Random(seed)
    parts = ["{", "}", "{", "}", "\n", "a", " ", ";", '"', "'", "`", "/*", "*/", "//", "\\", '"}"', "`{\n`", "/* } */", "// {\n"]
    codes = {f"f{k}": "".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for k in range(60)}
    found = told(spark, **codes)
    for name, code in codes.items():
        ours = sorted((r[4], r[5]) for r in found if r[0] == name)
        assert ours == sorted((b, d) for _, b, d in plain(code)), (name, code)


def test_odd_contents(spark):
    assert told(spark, none=None, empty="", text="no braces at all", closing="}}}") == []
    deep = "{" * 5000 + '"' + "\\n" * 20000 + '"' + "}" * 5000
    long = told(spark, long="x " * 500_000 + "{" + "// c\n" * 20000 + "}")
    assert [r[3:] for r in long] == [(1, 20001, 0)]
    assert len(told(spark, deep=deep)) == 5000


def test_outermost_and_weight(spark):
    found = braces.units(spark.createDataFrame([("js", JS)], "file_path string, content string"))
    assert sorted(r.name for r in braces.outermost(found, ["class", "function"]).collect()) == ["A", "f"]
    w = spark.createDataFrame([("function", "eval(x)"), ("function", "f"), ("class", "x"), ("control", "sql")], "k string, c string")
    from pyspark.sql import functions as F

    assert [r[0] for r in w.select(braces.weight(F.col("k"), F.col("c"))).collect()] == [0.95, 0.9, 1.0, 0.85]
