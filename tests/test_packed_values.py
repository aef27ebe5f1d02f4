import random
import re

from paronym.operators.packed_values import CANDIDATES, NEVER, explode_packed, score_delimiters, split_packed

PATTERN = "|".join(p for name, p in CANDIDATES.items() if name not in NEVER)


def _reference(text):
    """A plain scanner, one character at a time, for text whose brackets and quotes are closed."""
    values, held, depth, quote = [], "", 0, None
    for i, ch in enumerate(text):
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        if quote:
            held += ch
            if ch == quote and not (quote == '"' and (after == '"' or held.strip()[1:].count('"') % 2 == 0 and before == '"' and len(held.strip()) > 2)):
                quote = None
            continue
        if depth == 0 and not held.strip() and ch in "\"“":
            quote = {'"': '"', "“": "”"}[ch]
            held += ch
            continue
        depth += ch in "([" and 1 or ch in ")]" and -1 or 0
        spaced = ch in "/-–—" and before.isspace() and after.isspace()
        if depth == 0 and (ch in ";|\t\n\r•" or spaced):
            values.append(held)
            held = ""
        else:
            held += ch
    out = []
    for v in map(str.strip, [*values, held]):
        if len(v) > 1 and v[0] == '"' == v[-1]:
            v = v[1:-1].replace('""', '"').strip()
        elif len(v) > 1 and v[0] == "“" and v[-1] == "”":
            v = v[1:-1].strip()
        if v:
            out.append(v)
    return out


FIXED = [
    ('a; b (c; d) | "x; y"\t“p | q” ;;', ["a", "b (c; d)", "x; y", "p | q"]),
    ("um / dois/três - quatro-cinco – seis", ["um", "dois/três", "quatro-cinco", "seis"]),
    ("linhas, agulhas; 1,5 litro", ["linhas, agulhas", "1,5 litro"]),
    ('"caixas ""tipo maleta""; rígidas"; tela de 7"; b', ['caixas "tipo maleta"; rígidas', 'tela de 7"', "b"]),
    ("a\r\n- b\n- c", ["a", "b", "c"]),
    ("(a [b; c) d; e] f; g", ["(a [b; c) d", "e] f", "g"]),
    ("(aberto; b", ["(aberto", "b"]),
    ('"aberto; b', ['"aberto', "b"]),
    ('"a" de lã; b', ['"a" de lã', "b"]),
    (" ;; ", []),
    ("x; x; x", ["x", "x", "x"]),
    ("a - b", ["a", "b"]),
]


def test_fixed_cases():
    for text, values in FIXED:
        assert split_packed(text, PATTERN) == values, text


def _sample(rng):
    parts = ["botas", "tintas de lã", "linhas, agulhas e botões", "a (b; c)", "d [e | f (g; h)]", '"i; j"', "“k | l”", 'tela de 7"', '"m ""n""; o"', "e/ou", "guarda-chuvas"]
    out = ""
    for _ in range(rng.randrange(1, 8)):
        out += rng.choice(parts) + rng.choice([";", "; ", " ; ", "|", " | ", "\t", "\n", "\r\n", "•", " • ", " / ", " - ", " – ", "\n- "])
    return out


def test_random_fields_match_a_plain_scanner():
    rng = random.Random(4)
    for _ in range(2000):
        text = _sample(rng)
        assert split_packed(text, PATTERN) == _reference(text), text


def test_distributed_split_equals_the_function(spark):
    rng = random.Random(6)
    rows = [(i, _sample(rng), None if i % 5 == 0 else _sample(rng), rng.choice(["x", "y", None])) for i in range(300)]
    rows += [(1000 + i, t, "", "x") for i, (t, _) in enumerate(FIXED)] + [(2000, "  ", None, None), (2001, "item; " * 20_000, "(" * 5000 + ";a", "x"), (3, "a;b", "a;b", "x")]
    df = spark.createDataFrame(rows, "k int, a string, b string, s string")
    out = sorted((r.key, r.field, r.position, r.value, r["count"]) for r in explode_packed(df, "k", ["a", "b"], "s").collect())
    want = []
    for k, a, b, _ in rows:
        for f, v in (("a", a), ("b", b)):
            values = split_packed(v, PATTERN) if v else []
            want += [(k, f, i + 1, x, len(values)) for i, x in enumerate(values)]
    assert out == sorted(want)


def test_empty_table_and_clashing_columns(spark):
    schema = "k int, a string, s string, value string, pattern string, who string"
    assert explode_packed(spark.createDataFrame([], schema), "k", ["a"], "s").count() == 0
    df = spark.createDataFrame([(1, "x;y", "q", "v", "p", "w")], schema)
    assert [tuple(r) for r in explode_packed(df, "k", ["a"], "s").orderBy("position").collect()] == [(1, "a", 1, "x", 2), (1, "a", 2, "y", 2)]


def test_a_sign_that_does_not_part_values_is_not_active(spark):
    rows = [(i, "https|1|2|3" if i % 2 else "botas; tintas; velas", "s") for i in range(300)]
    scored = {r.delimiter: r for r in score_delimiters(spark.createDataFrame(rows, "k int, a string, s string"), "s", ["a"]).collect()}
    assert scored["semicolon"].active and not scored["bar"].active and not scored["comma"].active
    assert re.compile(PATTERN)


def test_a_small_source_follows_the_others_at_any_size(spark):
    for times in (4, 40):
        rows = [(i, "rua 1 - 2 - 3" if i % 2 else "botas; tintas", "s") for i in range(60 * times)] + [(-1, "a - 7 - 8", "few")]
        df = spark.createDataFrame(rows, "k int, a string, s string")
        scored = {(r.source, r.delimiter): r.active for r in score_delimiters(df, "s", ["a"]).collect()}
        assert scored["s", "semicolon"] and scored["few", "semicolon"] and scored["s", "spaced dash"] == scored["few", "spaced dash"]
    assert not scored["s", "spaced dash"]
    split = {r.key: r["count"] for r in explode_packed(df, "k", ["a"], "s").collect()}
    assert split[1] == split[-1] == 1 and split[0] == 2


def test_blanks_are_the_same_with_and_without_brackets(spark):
    wide = chr(0x2003)
    rows = [(0, f"tintas{wide}/{wide}botas"), (1, f"tintas{wide}/{wide}botas (x)"), (2, "a\x1c-\x1cb"), (3, "a\x1c-\x1cb (x)"), (4, "c\x01d; e")]
    out = {}
    for r in explode_packed(spark.createDataFrame(rows, "k int, a string"), "k", ["a"]).orderBy("position").collect():
        out.setdefault(r.key, []).append(r.value)
    assert out == {0: ["tintas", "botas"], 1: ["tintas", "botas (x)"], 2: ["a\x1c-\x1cb"], 3: ["a\x1c-\x1cb (x)"], 4: ["c\x01d", "e"]}
