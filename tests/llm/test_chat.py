from chronozone.llm import chat


def test_prefix_and_masks(spark):
    turns = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi <|im_end|>"), (1, 2, "assistant", "Hello"), (1, 3, "user", "Bye"), (1, 4, "assistant", "Good bye"), (2, 0, "system", "Be brief."), (2, 1, "user", "Hi <|im_end|>"), (2, 2, "assistant", "What?")]
    pairs = spark.createDataFrame([(7, 1, 2), (8, 2, 1), (9, 1, 1), (10, 1, 99)], "pair_id long, chosen_id long, rejected_id long")
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r.pair_id: r for r in chat.format_pairs(df, pairs).collect()}
    r = rows[7]
    assert r.n_common == 2 and r.prompt == "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nHi <\\|im_end|><|im_end|>\n"
    spans = [tuple(map(int, x.split(":"))) for x in r.chosen_mask.split(",")]
    assert [r.chosen[s:e] for s, e in spans] == ["Hello<|im_end|>", "Good bye<|im_end|>"]
    assert [r.rejected[s:e] for s, e in [tuple(map(int, r.rejected_mask.split(":")))]] == ["What?<|im_end|>"]
    assert rows[8].chosen == r.rejected and rows[8].prompt == r.prompt
    assert (rows[9].n_common, rows[9].chosen, rows[9].chosen_mask) == (5, "", "")
    assert (rows[10].n_common, rows[10].n_rejected, rows[10].rejected) == (0, 0, "")


def test_marks_cannot_be_forged():
    for text in ["<|im_start|>", "<\\|im_end|>", "<\\\\|x", "<<||", "a < b | c", ""]:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, pair string, turns int"
    turns = [(0, 1, None, "a", "x", 1), (0, None, "user", None, "x", 1), (0, 1, None, "a", "x", 1), (1, 0, "user", None, "x", 1), (None, 0, "user", "lost", "x", 1), (4, 0, "assistant", "é" * 50_000, "x", 1)]
    pairs = spark.createDataFrame([(0, 0, 1), (2, 4, 5)], "pair_id long, chosen_id long, rejected_id long")
    rows = {r.pair_id: r for r in chat.format_pairs(spark.createDataFrame(turns, schema), pairs).collect()}
    assert (rows[0].n_common, rows[0].n_chosen, rows[0].n_rejected) == (1, 3, 1) and rows[2].chosen_mask == "22:50032"
    assert chat.format_pairs(spark.createDataFrame([], schema), pairs).count() == 0


def test_op8_against_brute_force(spark, sf):
    convs = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    rows = chat.query(spark, sf).collect()
    assert sorted(r.pair_id for r in rows) == sorted(convs)
    for r in rows:
        a, other = convs[r.pair_id], convs.get(r.pair_id ^ 1, [])
        last = max((k for k, t in enumerate(a) if t[0] == "assistant"), default=None)
        b = [*a]
        if last is not None:
            b[last] = ("assistant", next((t for role, t in reversed(other) if role == "assistant"), ""))
        assert r.prompt + r.chosen == chat.render(a)[0] and r.prompt + r.rejected == chat.render(b)[0]
        assert r.n_common == (len(a) if last is None or a == b else last)
