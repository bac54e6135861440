from skein.operators import sequential
from skein.plans import registry


def test_turns_are_aligned_by_all_words(spark, tmp_path):
    """Turns that differ after the fifth word only are not equal."""
    same = "one two three four five "
    turns = [(1, t, "user", same + " ".join(f"w{t}x{i}" for i in range(20))) for t in range(4)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.a, r.b) for r in sorted(registry.QUERIES["align_events"](spark, str(tmp_path)).collect(), key=lambda r: r.step)]
    notes = [frozenset(t.split(" ")) for *_, t in turns]
    assert got == sequential.align(notes, [notes[0], notes[2], notes[3]])
    assert got == [(0, 0), (1, None), (2, 1), (3, 2)]
