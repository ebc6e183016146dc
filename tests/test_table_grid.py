"""Cells that span rows and columns, and character references, against plain Python."""

import random

from pyspark.sql import functions as F

from fathomline.functions import markup


def plain_grid(rows):
    """Carried cells first, where their column comes; wide cells in one piece."""
    grid, carried = [], []
    for cells in rows:
        line, after, carried = [], [], list(carried)

        def carry():
            col, text, left = carried.pop(0)
            line.append(text)
            if left > 1:
                after.append((col, text, left - 1))

        for text, wide, tall in cells:
            while carried and carried[0][0] <= len(line):
                carry()
            for _ in range(wide):
                if tall > 1:
                    after.append((len(line), text, tall - 1))
                line.append(text)
        while carried:
            carry()
        grid.append(line)
        carried = after
    while carried:
        grid.append([t for _, t, _ in carried])
        carried = [(c, t, n - 1) for c, t, n in carried if n > 1]
    return grid


def test_random_tables(spark):
    rng = random.Random(8)
    tables = [[[(f"r{i}c{j}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3, 5])) for j in range(rng.randint(0, 4))] for i in range(rng.randint(0, 6))] for _ in range(200)]
    html = [(k, "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan='{h}'>{t}</td>" for t, w, h in r) + "</tr>" for r in rows) + "</table>") for k, rows in enumerate(tables)]
    df = spark.createDataFrame(html, "k int, html string")
    for r in df.select("k", markup.table_cells(F.col("html")).alias("cells")).collect():
        assert r.cells == plain_grid(tables[r.k]), tables[r.k]


def test_tables_without_tall_cells_are_as_before(spark):
    df = spark.createDataFrame([("<table><tr><th>a</th><th colspan=2>b</th></tr><tr><td rowspan=0>1</td><td rowspan=x>2</td></tr><tr></tr></table>",), ("",), (None,)], "html string")
    got = [r.cells for r in df.select(markup.table_cells(F.col("html")).alias("cells")).collect()]
    assert got[:2] == [[["a", "b", "b"], ["1", "2"], []], []] and not got[2]


def test_character_references(spark):
    cases = {"&#36;391,035": "$391,035", "&#8226; a": "• a", "x&#x1F600;y&#X41;": "x😀yA", "&#0; &#xD800; &#1114112; &#; &#x;": "&#0; &#xD800; &#1114112; &#; &#x;", "&amp;#36;": "&#36;", "&#38;amp;": "&", "&#160;&#8217;": " '", "": "", "no": "no"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.x for r in df.select("t", markup.entities(F.col("t")).alias("x")).collect()}
    assert got == cases | {None: None}
