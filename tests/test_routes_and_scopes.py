"""Route calls in source lines, ends of blocks, and bounded lists in reports."""

from __future__ import annotations

from brindle.functions import analysis
from brindle.functions.code import block_end
from brindle.sources import corpora


def test_route_calls(spark):
    kotlin = 'get("/a") { }; x.post ( "/b/{id}" ) {}\n  delete("")\n forget("/no")\n get("/c", h)\nput("/d(e)") { call(get("/f")) }\npatch("/unended'
    typescript = "app.get('/a', h); my.router.post(\"/b\", (req) => {})\napp.put('/c')\nother.get('/d', h)\nget('/e', h)\nrouter . patch ( '/f' , h)\nreturn app.delete('/g(x)', f(app.get('/h', 1)))"
    files = spark.createDataFrame([("a.kt", kotlin), ("b.ts", typescript), ("c.py", 'get("/x")'), ("d.kt", None), ("e.kt", "")], "file string, value string")
    got = sorted((r["file"], r["line"], r["method"], r["path"], r["handler"]) for r in corpora.routes_in(files).collect())
    kt, ts = "kotlin_ktor", "typescript_express"
    assert got == sorted([
        ("a.kt", 1, "GET", "/a", kt), ("a.kt", 1, "POST", "/b/{id}", kt), ("a.kt", 5, "PUT", "/d(e)", kt), ("a.kt", 5, "GET", "/f", kt),
        ("b.ts", 1, "GET", "/a", ts), ("b.ts", 1, "POST", "/b", ts), ("b.ts", 5, "PATCH", "/f", ts), ("b.ts", 6, "DELETE", "/g(x)", ts), ("b.ts", 6, "GET", "/h", ts),
    ])


def test_routes_of_odd_lines(spark):
    """Paths with many brackets, and long lines of calls that come to nothing."""
    many = "/a" + "(" * 30
    kotlin = f'get("{many}")\n\tget ("/t")\nx.get\t("/no")\n' + 'get("' * 20_000 + "\n" + "get(" * 20_000 + '\nforgét("/no") get( "/b" )get("/c")'
    typescript = f"router.put('{many}', h)\nmyapp.get('/no', h)\na.b(app . \tget('/d\"', h))\n" + "app." * 20_000 + "\napp.get(\"/e\" , h); app.get('/f\", h)"
    files = spark.createDataFrame([("a.kt", kotlin), ("b.ts", typescript)], "file string, value string")
    got = sorted((r["file"], r["line"], r["method"], r["path"]) for r in corpora.routes_in(files).collect())
    assert got == sorted([("a.kt", 1, "GET", many), ("a.kt", 2, "GET", "/t"), ("a.kt", 6, "GET", "/b"), ("a.kt", 6, "GET", "/c"), ("b.ts", 1, "PUT", many), ("b.ts", 3, "GET", '/d"'), ("b.ts", 5, "GET", "/e")])


def test_python_blocks():
    lines = ["def f():", "    a", "", "      b", "x", "def g():", "    c"]
    assert [block_end(lines, i, "python") for i in (0, 1, 4, 5)] == [3, 3, 4, 6]


def test_severe_ids_are_bounded(spark):
    rows = spark.range(500).selectExpr("'success' as status", "if(id % 2 = 0, 'HIGH', null) as severity", "'t' as tool", "format_string('%04d', id) as id")
    row = analysis.summary(rows, most=3).first()
    assert (row["n_severe"], row["severe"]) == (250, ["0000", "0002", "0004"])
    none = analysis.summary(rows.limit(0)).first()
    assert (none["n"], none["n_severe"], none["severe"]) == (0, 0, [])
