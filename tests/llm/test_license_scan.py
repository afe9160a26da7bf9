import re
from collections import Counter

import pytest

from lodeworks.llm import license_scan, oracles, queries
from tests.compare import connect, difference
from tests.llm.fixtures import SF, documents, empty, key_rows, odd_documents

MIT = license_scan.MIT_GRANT
ROWS = [
    (900, "Intro\nReleased under the MIT License.\nreleased UNDER the mit-license!\nend", None, None, None),
    (901, MIT, None, None, None), (902, MIT.replace("copies", "COPIES").replace(" ", "\n", 3), None, None, None),
    (903, "All rights reserved", None, None, None), (904, "all rights\nreserved", None, None, None), (905, "x " + MIT[:300], None, None, None),
    (906, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", None, None, None), (906, "All rights reserved.", None, None, None), (906, "All rights reserved.", None, None, None),
    (None, "All rights reserved.", None, None, None), (907, "Licensed under the\tApache License;Version 2.0 " * 2, None, None, None),
]


def plain(text, percent=80):
    lines = (text or "").split("\n")
    hits = []
    for u, unit in enumerate(lines + ([text] if len(lines) > 1 else [])):
        words = re.findall("[a-z0-9]+", unit.lower())
        own = Counter(zip(words, words[1:]))
        for name, template in license_scan.TEMPLATES:
            other = license_scan.words_of(template)
            shared = sum((own & Counter(zip(other, other[1:]))).values())
            total = len(words) - 1 + len(other) - 1
            if len(words) > 1 and 100 * 2 * shared >= percent * total:
                hits.append((-round(2 * shared / total, 6), name, u))
    best = min(hits) if hits else (0.0, "")
    return len({h[2] for h in hits}), ",".join(sorted({h[1] for h in hits})), best[1], -best[0]


@pytest.mark.parametrize("percent", [80, 50])
def test_equals_plain(spark, percent):
    rows = odd_documents() + ROWS
    expected = [(r[0], *plain(r[1], percent)) for r in rows]
    found = license_scan.report(documents(spark, clashing=True, rows=rows), min_percent=percent).collect()
    assert key_rows(found) == key_rows(expected)
    assert sum(x[1] > 0 for x in expected) >= 8


def test_equals_sql(spark):
    sql = oracles.op8(license_scan.template_rows(), 80)
    assert difference(license_scan.report(spark.read.parquet(f"{SF}/documents.parquet")), connect(SF).sql(sql)) == ""


def test_empty_table(spark):
    assert license_scan.report(empty(spark)).count() == 0


def test_native(spark):
    plan = license_scan.matches(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_runs(text, percent=80):
    """Licence to the best Dice of any run of words."""
    words, best = re.findall("[a-z0-9]+", (text or "").lower()), {}
    grams = list(zip(words, words[1:]))
    for name, template in license_scan.TEMPLATES:
        other = license_scan.words_of(template)
        bag, size = Counter(zip(other, other[1:])), len(other) - 1
        for a in range(len(grams)):
            seen, shared = Counter(), 0
            for z in range(a, min(len(grams), a + 3 * size)):
                seen[grams[z]] += 1
                shared += seen[grams[z]] <= bag[grams[z]]
                if 200 * shared >= percent * (z - a + 1 + size):
                    best[name] = max(best.get(name, 0), round(2 * shared / (z - a + 1 + size), 6))
    return best


def wrapped(text, mark="", width=70):
    return "\n".join(f"{mark} {x}".strip() for x in re.sub(f"(.{{1,{width}}})(?: |$)", "\\1\n", text).strip().split("\n"))


def test_whole_licence_files_and_comments(spark):
    """Whole texts, wrapped, under a title and a copyright line, as comments above code or alone: found as what they are. Runs are looked for
    where no line and not the whole text has the licence, so the best Dice may be a line's or the whole text's."""
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(80))
    rows, expected = [], []
    whole = {n: t for n, t in license_scan.TEMPLATES if len(t) > 100}
    for i, (name, text) in enumerate(sorted(whole.items())):
        for k, doc in enumerate((f"Title of it\n\nCopyright (c) 2021 A. B.\n\n{wrapped(text)}\n", wrapped(text, "//") + "\n\n" + code, "/*\n" + wrapped(text, " *", 60) + "\n */\n" + code)):
            rows.append((10 * i + k, doc, None, None, None))
            expected.append((10 * i + k, name))
    found = license_scan.report(documents(spark, rows=rows), runs=True).collect()
    assert sorted((r.doc_id, r.best_licence) for r in found) == expected and len(whole) >= 9
    assert all(r.best_dice >= 0.8 for r in found) and sum(r.best_dice > 0.99 for r in found) >= len(whole)


GPL = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
PASSAGES = [
    (1, "MIT License\n\nCopyright (c) 2020 A B\n\n" + re.sub("(.{60,75}) ", "\\1\n", MIT) + "\n\nTHE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND\n" + "more words here " * 60),
    (2, "# a file\n" + re.sub("(.{50,65}) ", "# \\1\n", GPL) + "\nimport os\n" + "x = call(y)\n" * 50),
    (3, "This tool has a page. Released under the MIT License. It also has a manual of many pages and more."),
    (4, "Copyright A B. All\nrights reserved. " + "word " * 30 + "Licensed under CC BY-NC 4.0, as said."),
    (5, "Released under the MIT License.\n" + "The code is released under the MIT license, as all know by now. " * 3),
    (6, "All of these rights were reserved under the terms of the license " * 20), (7, None), (8, ""), (9, "one"), (3, "All rights reserved, they say."),
    (10, " ".join(w if i % 9 else f"{w} extra" for i, w in enumerate(MIT.split()))),
]


@pytest.mark.parametrize("percent", [80, 65])
def test_runs_over_lines_and_inside_lines(spark, percent):
    rows = [(i, t, None, None, None) for i, t in PASSAGES] + [(10, PASSAGES[-1][1], None, None, None)]
    expected = []
    for i, t, *_ in rows:
        units, names, _, _ = plain(t, percent)
        best = plain_units(t, percent)
        new = {n: d for n, d in plain_runs(t, percent).items() if n not in best}
        every = best | new
        top = min(((-d, n) for n, d in every.items()), default=(0.0, ""))
        expected.append((i, units + len(new), ",".join(sorted(every)), top[1], -top[0]))
    found = license_scan.report(documents(spark, rows=rows), min_percent=percent, runs=True).collect()
    assert key_rows(found) == key_rows(expected)
    licences = {r.doc_id: r.licences for r in found}
    assert [licences[k] for k in (1, 2, 10)] == ["MIT", "GPL-3.0", "MIT"]
    assert license_scan.report(documents(spark, rows=rows[:3])).where("n_units > 0").isEmpty()


def plain_units(text, percent):
    """Licence to the best Dice of the lines and the whole text."""
    best = {}
    lines = (text or "").split("\n")
    for unit in lines + ([text] if len(lines) > 1 else []):
        words = re.findall("[a-z0-9]+", unit.lower())
        for name, template in license_scan.TEMPLATES:
            other = license_scan.words_of(template)
            shared = sum((Counter(zip(words, words[1:])) & Counter(zip(other, other[1:]))).values())
            if len(words) > 1 and 200 * shared >= percent * (len(words) + len(other) - 2):
                best[name] = max(best.get(name, 0), round(2 * shared / (len(words) + len(other) - 2), 6))
    return best


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sql = oracles.op8(license_scan.template_rows(), 80)
    folder = f"/root/testdata/{sf}"
    assert difference(queries.op8_license_scan(spark, folder), connect(folder).sql(sql)) == ""


def test_runs_of_an_empty_table(spark):
    assert license_scan.report(empty(spark), runs=True).count() == 0
