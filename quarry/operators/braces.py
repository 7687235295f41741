"""Code units of languages with braces (JavaScript, TypeScript, Go, Java, C, C++, C#, Rust, PHP): kinds, names and ends.

A file is cut into comments, strings and other text by one regular expression; comments and strings are emptied but for
their line ends, and what is left is cut behind each brace. A block's head lies in the stretch before its brace, so it is told
there, by a fold over the stretch's pieces, before the one shuffle by file, which moves a short row for each brace. Depths and
lines are prefix sums there, and at one depth openings and closings take turns, so a block's end is the next row of its depth.

A block's head is its statement so far. A semicolon ends a statement, and so does a line end, unless a parenthesis is open;
a line end also doesn't before a line that goes on (``GOES_ON``) or begins with the block's brace, or behind a line that
asks for more (``MORE``), nor a semicolon in a head without parentheses (``for i := 0; i < n; i++ {``).

Null contents have no units. A string without its end ends with its line, a comment or template without it with the file,
a block without it at the file's last line; closings without a block are left out. Regular expression literals are not
told from divisions, so a quote or brace in one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.units import SECURITY_WORDS

#: Comments and strings. The repeated groups are possessive, so Java matches them without recursion.
COMMENT = r"/\*[\s\S]*?(?:\*/|\z)|//[^\n]*+"
STRINGS = [r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?", r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"]
TOKEN = "|".join([COMMENT, *STRINGS, r"""[^/"'`]++""", "/"])
#: Words that begin a control block, words before a type's name, words before a function's.
CONTROL = "if else for foreach while do switch case try catch finally match select loop unless synchronized with".split()
TYPES = "class interface struct enum trait impl namespace union record object module package".split()
FUNCTIONS = "function func fn fun def".split()
_NAME = r"[A-Za-z_$][A-Za-z_$0-9]*"
#: How a line begins that goes on with the statement before it, how one ends that asks for more, and how a head
#: begins that may hold semicolons outside of parentheses.
GOES_ON = r"^(?:(?:extends|implements|permits|throws|where)\b|[:,.?&|=])"
MORE = r"[,=&|?+(]$"
OPEN_HEAD = r"^(?:for|if|switch)\s+[^(\s]"
#: Text whose parentheses are closed, nested twice at most; possessive, so Java matches it without recursion.
BALANCED = r"^[^()]*+(?:\((?:[^()]++|\([^()]*+\))*+\)[^()]*+)*+\z"
#: What Java's regular expressions call white space.
_WHITE = " \t\n\x0b\f\r"
#: Kinds by a block's head, the first that matches; the last group that matches is the name.
HEADS = [
    ("control", rf"^(?:{'|'.join(CONTROL)})\b()"),
    ("function", rf"\b(?:{'|'.join(FUNCTIONS)})\b\s*\*?\s*(?:\([^()]*\)\s*)?({_NAME})?"),
    ("class", rf"\btype\s+({_NAME})\s+(?:struct|interface)\b"),
    ("class", rf"\b(?:{'|'.join(TYPES)})\s+({_NAME})"),
    ("function", rf"({_NAME})\s*[=:]\s*(?:async\s*)?(?:\([^()]*\)|{_NAME})\s*(?::\s*[A-Za-z_0-9<>, ]+)?=>$"),
    ("function", r"()=>$"),
    ("function", rf"({_NAME})\s*\([^=]*\)[^()=]*$"),
]
#: What a unit weighs, and what one with a security word does.
WEIGHTS = {"class": (1.0, 1.0), "function": (0.9, 0.95), "control": (0.7, 0.85), "block": (0.5, 0.5)}


def emptied(content: Column) -> Column:
    """``content`` without comments and with empty strings; every line end stays."""
    ends = lambda t: F.regexp_replace(t, r"[^\n]+", "")

    def piece(t: Column) -> Column:
        first, two = F.substring(t, 1, 1), F.substring(t, 1, 2)
        return F.when(two.isin("//", "/*"), ends(t)).when(first.isin('"', "'", "`"), F.concat(F.lit('""'), ends(t))).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(TOKEN), 0), piece), "")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _head(stretch: Column) -> Column:
    """The pieces of a stretch that ends with ``{``: sep (; or a line end or {), open (parentheses opened less those closed), blank,
    text where it may belong to a block's head, and what the text tells of the statement: long (its head may hold semicolons),
    more (asks for more), on (goes on with the statement before)."""

    def piece(x: Column) -> Column:
        sep = F.right(x, F.lit(1))
        text = F.btrim(F.when(sep == "\n", x).otherwise(F.left(x, F.length(x) - 1)), F.lit(_WHITE))
        return F.struct(sep.alias("sep"), (_count(x, "(") - _count(x, ")")).alias("open"), text.alias("text"))

    def told(x: Column) -> Column:
        text, sep, blank = x["text"], x["sep"], x["text"] == ""
        long = text.rlike(OPEN_HEAD)
        kept = ~blank & ((sep != ";") | (x["open"] > 0) | long)
        on = (kept & text.rlike(GOES_ON)) | (blank & (sep == "{"))
        return F.struct(sep.alias("sep"), x["open"].alias("open"), blank.alias("blank"), F.when(kept, text).alias("text"), long.alias("long"), F.right(text, F.lit(2)).rlike(MORE).alias("more"), on.alias("on"))

    return F.transform(F.transform(F.split(stretch, r"(?<=[;\n])", -1), piece), told)


def _last(pieces: Column) -> Column:
    """begin (how many of a stretch's pieces lie before its last statement) and at (how many line ends lie before that
    statement's first text): one fold over the pieces. A line end waits for the next piece that isn't an empty line, which may
    go on with the statement."""
    start = {"k": 0, "sum": 0, "low": 0, "ends": 0, "long": False, "wait": -1, "begin": 0, "at": -1}
    none = F.struct(*[F.lit(v).alias(k) for k, v in start.items()])

    def count(a: Column, x: Column) -> Column:
        fresh = (a["wait"] >= 0) & (~x["blank"] | (x["sep"] != "\n"))
        own = fresh & ~x["on"]
        at = F.when(own, -1).otherwise(a["at"])
        return F.struct(
            a["k"].alias("k"), (a["sum"] + x["open"]).alias("sum"), a["low"].alias("low"), a["ends"].alias("ends"), (a["long"] | x["long"]).alias("long"), F.when(fresh, -1).otherwise(a["wait"]).alias("wait"),
            F.when(own, a["wait"]).otherwise(a["begin"]).alias("begin"), F.when(x["blank"] | (at >= 0), at).otherwise(a["ends"]).alias("at"))

    def step(a: Column, x: Column) -> Column:
        # the counts are bound as an argument, lest each use takes them anew
        def close(c: Column) -> Column:
            closed, line = c["sum"] <= c["low"], x["sep"] == "\n"
            over = closed & (x["sep"] == ";") & ~c["long"]
            return F.struct(
                (c["k"] + 1).alias("k"), c["sum"].alias("sum"), F.least(c["low"], c["sum"]).alias("low"), F.when(line, c["ends"] + 1).otherwise(c["ends"]).alias("ends"), (c["long"] & ~line).alias("long"),
                F.when(line & closed & ~x["blank"] & ~x["more"], c["k"] + 1).otherwise(c["wait"]).alias("wait"), F.when(over, c["k"] + 1).otherwise(c["begin"]).alias("begin"), F.when(over, -1).otherwise(c["at"]).alias("at"))

        return F.element_at(F.transform(F.array(count(a, x)), close), 1)

    # a statement of blank pieces alone begins at its brace
    return F.aggregate(pieces, none, step, lambda a: F.struct(a["begin"].alias("begin"), F.when(a["at"] >= 0, a["at"]).otherwise(a["ends"]).alias("at")))


def stretches(files: DataFrame) -> DataFrame:
    """file_path, n_lines (of the file), pos, sep ({ or }), ends (line ends in it) of each stretch of text up to a brace; kind, name
    and at (line ends before its head) of the block that it opens."""
    n = _count(F.col("content"), "\n") + F.when(F.col("content").endswith("\n"), 0).otherwise(1)
    told = files.select("file_path", n.alias("n_lines"), F.split(emptied(F.col("content")), r"(?<=[{}])", -1).alias("p"))
    cut = told.select("file_path", "n_lines", F.posexplode("p").alias("pos", "t")).withColumn("sep", F.right("t", F.lit(1))).where("sep in ('{', '}')")
    # most heads are all that stands behind the last semicolon, on one line: no fold is needed for these
    cut = cut.withColumns({"ends": _count(F.col("t"), "\n"), "own": F.when(F.col("sep") == "{", F.ltrim(F.substring_index("t", ";", -1), F.lit(_WHITE)))})
    short = F.rtrim(F.left("own", F.length("own") - 1), F.lit(_WHITE))
    before = F.left("t", F.length("t") - F.length(F.substring_index("t", ";", -1)))
    plain = (F.col("own") != "{") & ~F.col("own").contains("\n") & ((before == "") | (before.rlike(BALANCED) & ~before.rlike(OPEN_HEAD[1:])))
    cut = cut.withColumn("short", F.when(plain, short))
    cut = cut.withColumn("p", F.when((F.col("sep") == "{") & F.col("short").isNull(), _head(F.col("t")))).withColumn("last", _last(F.col("p")))
    head = F.coalesce("short", F.array_join(F.transform(F.slice("p", F.col("last.begin") + 1, F.size("p")), lambda x: x["text"]), " "))
    at = F.when(F.col("short").isNotNull(), F.col("ends")).otherwise(F.col("last.at"))
    headed = cut.select("file_path", "n_lines", "pos", "sep", "ends", at.alias("at"), head.alias("head")).withColumn("rule", _rule(F.col("head")))
    return headed.select("file_path", "n_lines", "pos", "sep", "ends", "at", *_told(F.col("head"), F.col("rule")))


def _rule(head: Column) -> Column:
    """The place in ``HEADS`` of the first that matches a block's head, or -1."""
    out = None
    for k, (_, pattern) in enumerate(HEADS):
        out = F.when(head.rlike(pattern), k) if out is None else out.when(head.rlike(pattern), k)
    return out.otherwise(-1)


def _told(head: Column, rule: Column) -> list[Column]:
    """Kind and name by a block's head and the rule that it matches."""
    kind, name = F.when(rule == -1, "block"), F.when(rule == -1, None)
    for k, (what, pattern) in enumerate(HEADS):
        kind = kind.when(rule == k, what)
        if "()" not in pattern.replace("[^()", ""):  # other rules tell no name
            name = name.when(rule == k, F.nullif(F.regexp_extract(head, pattern, 1), F.lit("")))
    return [kind.alias("kind"), name.cast("string").alias("name")]


def units(files: DataFrame) -> DataFrame:
    """file_path, kind (class, function, control, block), name (null without one), start_line (of its head), end_line,
    depth (0 outside of all blocks) of each block of ``files`` (file_path, content); a path names one file."""
    by_file = Window.partitionBy("file_path").orderBy("pos")
    before, upto = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("sep") == "{"
    told = stretches(files).withColumns({"first": F.coalesce(F.sum("ends").over(before), F.lit(0)) + 1, "depth": F.sum(F.when(opens, 1).otherwise(-1)).over(upto)})
    told = told.withColumns({"line": F.col("first") + F.col("ends"), "level": F.col("depth") - F.when(opens, 1).otherwise(0)})
    turn = Window.partitionBy("file_path", "level").orderBy("pos")
    blocks = told.withColumn("end", F.coalesce(F.lead("line").over(turn), "n_lines")).where(opens)
    return blocks.select("file_path", "kind", "name", (F.col("first") + F.col("at")).cast("int").alias("start_line"), F.col("end").cast("int").alias("end_line"), F.col("level").cast("int").alias("depth"))


def weight(kind: Column, content: Column) -> Column:
    """What a unit weighs by its kind, and by whether its content holds a security word."""
    safe = F.lower(content).rlike("|".join(x.replace(".", r"\.") for x in SECURITY_WORDS))
    out = None
    for k, (plain, more) in WEIGHTS.items():
        value = F.when(safe, more).otherwise(plain)
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out


def outermost(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Units of these kinds that lie within no other such unit of their file: those that begin behind every end before."""
    within = Window.partitionBy("file_path").orderBy("start_line", F.desc("end_line"), "depth").rowsBetween(Window.unboundedPreceding, -1)
    wanted = found.where(F.col("kind").isin(kinds))
    return wanted.withColumn("_end", F.max("end_line").over(within)).where("_end is null or start_line > _end").drop("_end")
