"""Line and substring deduplication against brute force."""

import random

from cartwise.llm import line_dedup, substring_dedup


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of_lines(seed=1, n=60):
    r = random.Random(seed)
    common = ["The quick brown fox jumps over the lazy dog again %d" % i for i in range(8)]
    rows = [(i, "\n".join(r.choice([r.choice(common), "  " + r.choice(common).upper() + "\t", "short",
                                    "an own line of this document, number %d of %d" % (j, i)]) for j in range(r.randint(0, 12))))
            for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, rows[3][1]), (n + 4, "é" * 39 + "\n" + "é" * 40)] + [
        (n + 10 + k, "é" * 39 + "\n" + "É" * 20 + "é" * 20) for k in range(6)]


def test_lines_match_brute_force(spark):
    rows = rows_of_lines()
    got = {r[0]: tuple(r)[1:] for r in line_dedup.digest(line_dedup.dedup_lines(documents(spark, rows))).collect()}
    assert got == line_dedup.brute_force(rows)


def test_lines_in_slices_give_the_same(spark):
    rows = rows_of_lines(2)
    got = {r[0]: tuple(r)[1:] for r in line_dedup.digest(
        line_dedup.dedup_lines(documents(spark, rows), max_filter_bits=line_dedup.SEGMENT_BITS, bits_per_line=2000)).collect()}
    assert got == line_dedup.brute_force(rows)


def test_lines_empty_null_and_extra_columns(spark):
    empty = line_dedup.dedup_lines(documents(spark, []))
    assert empty.columns == ["doc_id", "text", "n_lines", "n_dropped"] and empty.count() == 0
    line = "a line of more than forty characters, held by six"
    df = spark.createDataFrame([(i if i else None, line, "x", i) for i in range(7)],
                               "doc_id long, text string, key string, n_lines int")
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[None]["text"] == line and out[6]["text"] == line and out[1]["text"] == "" and out[1]["key"] == "x"
    assert out[1]["n_lines"] == 1


def test_rows_that_share_an_id_are_one_document(spark):
    line = "a line of more than forty characters, held by some"
    rows = [(1, line), (1, line), (1, "x\n" + line), (2, line), (3, line), (4, line)]
    out = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert {r["n_dropped"] for r in out} == {0} and len(out) == 6  # four documents hold it
    out = line_dedup.dedup_lines(documents(spark, rows + [(5, line)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, ""), (1, ""), (1, "x"), (2, ""), (3, ""), (4, ""), (5, line)]


def word_rows(seed=1, n=50):
    r = random.Random(seed)
    passages = [" ".join("p%d_%d" % (k, i) for i in range(r.randint(13, 40))) for k in range(5)]
    rows = [(i, " ".join(r.choice([r.choice(passages), "w%d" % r.randint(0, 9), "é\t\n"]) for _ in range(r.randint(0, 15))))
            for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, rows[5][1]), (n + 4, "a " * 40), (n + 5, "a " * 20)]


def test_substrings_match_brute_force(spark):
    rows = word_rows()
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.digest(
        substring_dedup.dedup_substrings(documents(spark, rows).repartition(5))).collect()}
    assert got == substring_dedup.brute_force(rows)


def test_common_windows_sent_aside(spark):
    rows = word_rows(3, 80)
    one = documents(spark, rows).coalesce(1)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.digest(substring_dedup.dedup_substrings(one)).collect()}
    assert got == substring_dedup.brute_force(rows)


def test_substrings_empty_null_and_extra_columns(spark):
    assert substring_dedup.dedup_substrings(documents(spark, [])).count() == 0
    text = " ".join("w%d" % i for i in range(20))
    df = spark.createDataFrame([(None, text, 1), (1, text, 2), (2, text + " more", 3)],
                               "doc_id long, text string, n_words int")
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(df).collect()}
    assert out[None]["text"] == text and out[1]["n_removed"] == 0 and out[2]["text"] == "more"
    assert out[2]["n_words"] == 21


def test_tables_of_hardly_any_text(spark):
    for rows in ([(1, "x")], [(1, "")], [(1, None)], [(1, "x"), (2, None)]):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in got) == [(*r, 0) for r in rows]
