"""Lines of white space alone have no words; a line of the letter f has one."""

from tidelog.llm import line_dedup


def test_blank_lines_stay_and_letters_are_words(spark):
    blank = " \t\r\x0b\x0c"
    rows = [(1, f"f\n{blank}\nff f\n\x0c\nu000b\nt\n\\"), (2, f"F\n\x0c\n{blank}\n f \x0c\n\nF FF\n\\ \nr"), (3, "u000b\n \nT\nr\x0c\n\x0b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_lines, sorted(r.removed)) for r in line_dedup.line_report(frame).collect()}
    assert found == {1: (7, []), 2: (8, [0, 3, 5, 6]), 3: (5, [0, 2, 3])}
    texts = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame).collect()}
    assert texts == {1: rows[0][1], 2: f"\x0c\n{blank}\n\nr", 3: " \n\x0b"}


def test_texts_are_put_into_lower_case_once_and_outside_generators(spark):
    rows = spark.createDataFrame([(1, "One\tLine\n two  Words ")], "d bigint, text string").repartition(1)
    assert [tuple(r) for r in line_dedup._lines(rows).collect()] == [(1, 0, "one line"), (1, 1, "two words")]
    counted = line_dedup.word_counts(rows)
    assert sum(counted.first().counts) == 4
    for frame in (line_dedup._lines(rows), counted):
        plan = frame._jdf.queryExecution().optimizedPlan().toString().replace("\n, -1", ", -1").splitlines()
        generators = [step for step in plan if "Generate " in step]
        assert generators and not any("lower(" in step for step in generators)
