from sanmaru.streaming.feeds import card_totals, run_card_totals


def line(code, date, txns, amount):
    return ",".join([code, date, "L", "M", "S", "p", "d", "1", "2", str(txns), str(amount)])


def test_files_are_folded_once(spark, tmp_path):
    feed, out, checkpoint = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "ck")
    feed.mkdir()
    (feed / "a.txt").write_text("\n".join([line("4812051000", "20250101", 2, 10.0), line("4812051000", "20250120", 3, 5.0), line("bad", "20250101", 9, 9.0)]))
    run_card_totals(spark, str(feed), out, checkpoint).awaitTermination(60)
    (feed / "b.txt").write_text(line("4812051000", "20250203", 1, 1.0) + "\n" + line("4812051000", "20250131", 1, 1.5))
    for _ in range(2):
        run_card_totals(spark, str(feed), out, checkpoint).awaitTermination(60)
    got = sorted(tuple(r) for r in card_totals(spark, out).collect())
    assert got == [("4812051000", "2025-01", 6.0, 16.5), ("4812051000", "2025-02", 1.0, 1.0)]
