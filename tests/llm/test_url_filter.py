"""URL verdicts against plain Python, rules against their definition, merging and purity."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import url_filter as u


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path, rules):
    best = None
    for verdict, text in rules:
        name, slash, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            best = max(best or (0,), (len(text), text, verdict))
    return best and best[1:]


def differ(a, na, b, nb):
    a, na, b, nb = map(float, (a, na, b, nb))
    return (a * nb - b * na) ** 2 * (na + nb) > u.Z2 * (a + b) * (na + nb - a - b) * na * nb


def by_hand(rows, rules=u.RULES, labels=None):
    """rows (page_id, url) -> {(page_id, host, path, rule, verdict, template, purity)}"""
    pages = []
    for page, url in rows:
        host, path = split(url)
        fit = rule(host, path, rules)
        mark = (labels or {}).get(page)
        told = fit[1] == "block" if fit else mark
        pages.append([page, host, path, fit, told, [s for s in path.split("/") if s], ""])
    for level in range(u.DEPTH):
        sums = defaultdict(lambda: [0, 0, 0, 0])
        for _, host, _, _, told, segments, node in pages:
            if len(segments) > level:
                for key in ((host, node), (host, node, segments[level])):
                    for i, more in enumerate((1, told is not None, bool(told), len(segments) == level + 1)):
                        sums[key][i] += more
        unlike = lambda x, y: differ(x[2], x[1], y[2], y[1]) or differ(x[3], x[0], y[3], y[0])
        apart = defaultdict(list)
        for key, own in sums.items():
            if len(key) == 3:
                whole = sums[key[:2]]
                if key[2] not in ("*", "**") and key[2][0] != "{" and own[0] >= u.SUPPORT and own[0] * u.LITERALS >= whole[0] and unlike(own, [a - b for a, b in zip(whole, own, strict=True)]):
                    apart[key[:2]].append((own[2] / own[1] if own[1] else -1.0, own[3] / own[0], key[2], own))
        branch = {}
        for at, line in apart.items():
            line.sort(key=lambda x: (x[0], x[1], x[2].encode()))
            runs = []
            for i, x in enumerate(line):
                if not i or unlike(x[3], line[i - 1][3]):
                    runs.append([])
                runs[-1].append(x[2])
            for run in runs:
                branch.update({(*at, s): run[0] if len(run) == 1 else "{" + "|".join(sorted(run)) + "}" for s in run})
        for p in pages:
            _, host, _, _, _, segments, node = p
            p.append(node + "/" + branch.get((host, node, segments[level]), "*") if len(segments) > level else node)
        pages = [[*p[:6], p[7]] for p in pages]
    sums = defaultdict(lambda: [0, 0])
    for p in pages:
        if len(p[5]) > u.DEPTH:
            p[6] += "/**"
        steps = [s for s in p[6].split("/") if s]
        p.append(["".join("/" + s for s in steps[:k]) for k in range(len(steps) + 1)])
        for over in p[7]:
            sums[p[1], over][0] += p[4] is not None
            sums[p[1], over][1] += bool(p[4])
    prior = (sum(bool(p[4]) for p in pages) + 1) / (sum(p[4] is not None for p in pages) + 2)
    out = []
    for page, host, path, fit, _, _, node, ways in pages:
        purity = prior
        for over in ways:
            purity = (sums[host, over][1] + purity * u.M) / (sums[host, over][0] + u.M)
        out.append((page, host, path, fit and fit[0], fit[1] if fit else "block" if purity > u.THRESHOLD else "allow", node, round(purity, 12)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:6], round(r[6], 12)) for r in df.select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect()), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string").repartition(parts)


def urls(n, seed=1):
    rng = random.Random(seed)
    hosts = ["a.example.com", "Example.org", "x.y.example.net", "blog.example.ORG", "b.com", "org", "notorg", "é.com"]
    out = []
    for i in range(n):
        host = rng.choices(hosts, [30, 10, 10, 10, 10, 2, 2, 2])[0]
        path = rng.choice(["", "/", "//"]) + rng.choice(["de", "fr", "es", "en", "*", "x"]) if rng.random() < 0.9 else ""
        path = "/" + path.lstrip("/") if path else rng.choice(["", "/"])
        if rng.random() < 0.8:
            path += "/" + rng.choice([str(rng.randint(1, 900)), "1", "tag", "**", ""]) + "/x" * rng.choice([0, 0, 0, 1, 4])
        out.append((i, f"{rng.choice(['http', 'https'])}://{host}{path}{rng.choice(['', '?q=/de/', '#/fr', '?a#b'])}"))
    return out


def test_against_plain_python(spark):
    for n in (1, 40, 900):
        rows = urls(n, seed=n)
        assert got(u.judge(frame(spark, rows))) == by_hand(rows)


def test_strange_rows(spark):
    rows = [(1, None), (None, "http://a.com/de/1"), (2, ""), (3, "no scheme /de/"), (4, "://"), (5, "x://://de/fr"), (6, "http://ORG?x"), (7, "http://org/"), (8, "http://a.org\n/es/\n"), (9, "http://É.org/" + "a/" * 300_000), (9, "http://É.org/"), (9, "http://É.org/")]
    want = by_hand(rows)
    assert got(u.judge(frame(spark, rows))) == want and len(want) == len(rows)
    extra = frame(spark, rows).withColumns({c: F.lit("z") for c in ("host", "path", "rule", "node", "segment", "n", "blocked", "literal", "html")})
    assert got(u.judge(extra)) == want
    assert u.judge(frame(spark, [])).count() == 0


def test_longest_rule_wins_on_the_host_and_its_subdomains(spark):
    rows = list(enumerate(["http://org/a", "http://x.ORG/", "http://x.org", "http://xorg/", "http://example.org/es/1", "http://a.example.org/es", "http://a.example.org/en/17", "http://counterexample.org/en/17", "http://b.com/fr/", "http://b.com/de/?x", "http://com/de/"]))
    found = {r.page_id: (r.rule, r.verdict) for r in u.judge(frame(spark, rows)).collect()}
    want = ["org/", "org/", None, None, "example.org/es/", "org/", "example.org/en/1", "org/", "com/fr/", "com/de/", "com/de/"]
    assert [found[i][0] for i in range(len(rows))] == want
    assert [found[i][1] for i in range(len(rows)) if want[i]] == [dict((r, v) for v, r in u.RULES)[w] for w in want if w]


def test_templates_learn_from_labels(spark):
    """Numbers become a wildcard; a branch of another kind stays apart and is rejected alone."""
    rows, labels = [], {}
    for i in range(400):
        kind = ("shop", "news", "blog", "spam")[i % 4]
        rows.append((i, f"http://h.net/{kind}/{i}"))
        if i % 3 == 0:
            labels[i] = int(kind == "spam")
    told = spark.createDataFrame(list(labels.items()), "page_id long, blocked int")
    found = u.judge(frame(spark, rows), rules=(), labels=told).collect()
    assert {r.template for r in found} == {"/{blog|news|shop}/*", "/spam/*"}
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in found)
    assert got(u.judge(frame(spark, rows), rules=(), labels=told)) == by_hand(rows, (), labels)


def test_without_labels_nothing_is_rejected(spark):
    found = u.judge(frame(spark, urls(60)), rules=()).collect()
    assert {r.verdict for r in found} == {"allow"} and {r.rule for r in found} == {None}


def test_the_main_path_is_native(spark):
    plan = u.judge(frame(spark, urls(60)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
