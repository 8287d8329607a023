from roadweave.operators import rejects as rj

GOOD = "00;009;009624;00;009;009122;16,9;17;,5"


def reasons(spark, lines):
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(lines)], "line_id int, raw_line string, OR_REG2 string")
    rows = rj.parse_rows(df, "raw_line", rj.TRAVEL_MATRIX).collect()
    return {r["line_id"]: (r["reject_reason"], r["broken_field"]) for r in rows}, {r["line_id"]: r for r in rows}


def test_reasons_and_values(spark):
    lines = [
        GOOD,
        GOOD + "\r",
        ' 00 ;"009";"009624"\t;0;9;9122; 1, ;2;3',
        "",
        None,
        "00;009;009624;00;009;009122;1;2",
        GOOD + ";9",
        '00;009;"009624;00;009;009122;1;2;3',
        '00;009;"0096"24;00;009;009122;1;2;3',
        '00;009;a"009624";00;009;009122;1;2;3',
        '00;"0;9";009624;00;009;009122;1;2;3',
        '00;"0""9";009624;00;009;009122;1;2;3',
        '00;" 09";009624;00;009;009122;1;2;3',
        "00;009;009624;00;009;009122;1,2,3;2;3",
        "00;009;0096245;00;009;009122;1;2;3",
        "00;009;009624;00;009;009122;,;2;3",
        "00;009;009624;00;009;009122;1;2;3\n",
        '00;"" "";009624;00;009;009122;1;2;3',
    ]
    got, rows = reasons(spark, lines)
    want = [None, None, None, "column_count", "column_count", "column_count", "column_count", "quoting", "quoting", "quoting"] + ["invalid_value"] * 7 + ["quoting"]
    assert [got[i][0] for i in range(len(lines))] == want
    assert rows[2]["OR_PROCOM"] == "009624" and rows[2]["TEP_TOT"] == 1.0 and rows[0]["TTP_TOT"] == 0.5
    assert got[13][1] == 7 and got[14][1] == 3 and got[6][1] == 10 and got[0][1] is None
    assert rows[13]["OR_PROCOM"] is None and rows[0]["OR_REG2"] == "kept"


def test_long_lines(spark):
    lines = [";" * 300_000, '"' * 200_000, '"' + "x" * 500_000, '"a""' * 50_000, "0" * 1_000_000 + ";" + GOOD]
    got, _ = reasons(spark, lines)
    assert [got[i][0] for i in range(5)] == ["column_count", "column_count", "quoting", "quoting", "column_count"]


def test_empty_and_clash(spark):
    import pytest

    df = spark.createDataFrame([], "raw_line string")
    assert rj.parse_rows(df, "raw_line", rj.TRAVEL_MATRIX).count() == 0
    with pytest.raises(ValueError):
        rj.parse_rows(spark.createDataFrame([("a", 1)], "raw_line string, or_reg int"), "raw_line", rj.TRAVEL_MATRIX)


def test_reasons_against_a_reader(spark):
    """The reason of random lines against a field-by-field reader written out by hand."""
    import random
    import re

    def reader(line):
        line = line[:-1] if line.endswith("\r") else line
        fields, i = [], 0
        while True:
            while i < len(line) and line[i] in " \t":
                i += 1
            if i < len(line) and line[i] == '"':
                j, value = i + 1, ""
                while True:
                    if j >= len(line):
                        return "quoting"
                    if line[j] == '"':
                        if line[j + 1 : j + 2] == '"':
                            value, j = value + '"', j + 2
                            continue
                        break
                    value, j = value + line[j], j + 1
                j += 1
                while j < len(line) and line[j] in " \t":
                    j += 1
                if j < len(line) and line[j] != ";":
                    return "quoting"
            else:
                j = line.find(";", i)
                j = len(line) if j < 0 else j
                value = line[i:j].rstrip(" \t")
                if '"' in value:
                    return "quoting"
            fields.append(value)
            if j >= len(line):
                break
            i = j + 1
        if len(fields) != 9:
            return "column_count"
        forms = [r"[0-9]{1,2}", r"[0-9]{1,3}", r"[0-9]{1,6}"] * 2 + [r"(?:[0-9]+,?[0-9]*|,[0-9]+)"] * 3
        return None if all(re.fullmatch(p, f) for p, f in zip(forms, fields)) else "invalid_value"

    rng = random.Random(5)
    lines = []
    for _ in range(4000):
        line = list(GOOD)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(line) + 1)
            if rng.random() < 0.7:
                line.insert(at, rng.choice('";; ",x1"\t'))
            elif line:
                del line[min(at, len(line) - 1)]
        lines.append("".join(line) + rng.choice(["", "", "\r", ";", '"']))
    got, _ = reasons(spark, lines)
    wrong = [(x, got[i][0], reader(x)) for i, x in enumerate(lines) if got[i][0] != reader(x)]
    assert not wrong, wrong[:5]
