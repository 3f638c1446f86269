"""Chat turns without a number."""

import oracle

from skywharf.llm import catalog, chat


def test_turns_without_a_number_stay_first_on_both_sides(spark):
    rows = [(0, None, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "a"), (0, 3, "user", "later"), (1, 1, "user", "r"), (1, 2, "assistant", "b")]
    turns = chat.contrast(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    sides = {side: sorted((r["turn"] or 0, r["text"]) for r in turns.where("pair_id = 0").collect() if r["side"] == side) for side in ("chosen", "rejected")}
    assert sides == {"chosen": [(0, "s"), (1, "q"), (2, "a")], "rejected": [(0, "s"), (1, "q"), (2, "b")]}
    assert chat.format_pairs(turns).where("pair_id = 0").first()["prompt_turns"] == 2


def test_sql_and_query_agree_on_turns_without_a_number(spark, tmp_path):
    rows = [(0, None, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "a"), (0, 3, "user", "later"), (1, None, None, None), (1, 2, "assistant", "b"), (2, None, "user", "x"), (None, 1, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    ok, message = oracle.compare(spark, con, "op2", catalog.QUERIES["op2_chat_preferences"], catalog.SQL["op2_chat_preferences"], str(tmp_path))
    assert ok, message
