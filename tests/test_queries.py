"""Queries over whole tables against brute force: no row is left out."""

from pagesift.plans import queries


def test_known_pages_of_all_entries(spark, tmp_path):
    rows = [(i, i % 6, f"https://a.com/{i % 9}" if i % 5 else None, f"a.com/{i % 9}" if i % 4 else ("" if i % 8 else None)) for i in range(40)]
    spark.createDataFrame(rows, "entry_id long, round_no int, url string, nurl string").write.parquet(f"{tmp_path}/ledger_entry.parquet")
    want = {(i, min((r for _, r, _, n in rows if n == f"a.com/{i % 9}"), default=None)) for i, _, url, _ in rows if url}
    got = [(r.entry_id, r.known_round) for r in queries.s8_known_pages(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 32 and set(got) == want


def test_whole_search_knows_every_round_and_body(spark, tmp_path):
    def article(k):
        return "".join(f"钠离子电芯的第{k * 31 + i * 7}项测试由第{k * 17 + i}实验室完成，循环寿命达到{k * 900 + i * 13}次，容量保持率为{60 + (k * 5 + i) % 40}%；" + chr(0x4E00 + k * 400 + i * 9) * 2 + f"研究所认为市场规模约为{k + 1}亿元。\n\n" for i in range(24))

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    urls = [f"https://h{k}.example/news/2024/a{k}.html" for k in range(6)]
    save("fetched_item", [(k, 1, k, u, "钠离子电芯 测试", article(k)) for k, u in enumerate(urls)], "item_id long, batch_id long, pos int, url string, page_title string, text string")
    save("search_batch", [(1, "钠离子电芯 测试")], "batch_id long, query string")
    save("candidate", [(1, k, u, "钠离子电芯 测试", None, ["fathom"] if k == 0 else ["lumen"]) for k, u in enumerate(urls)], "batch_id long, pos int, url string, title string, date string, engine array<string>")
    # delivered before: pages 1 and 2 by address, in rounds 3 and 5; page 3 by body, under another address
    save("ledger_entry", [(1, 3, "h1.example/news/2024/a1.html", ""), (2, 5, "h2.example/news/2024/a2.html", None), (3, 4, "mirror.example/x", "导语。" + article(3)), (4, 2, "mirror.example/y", article(3))], "entry_id long, round_no int, nurl string, body string")
    save("observation", [], "obs_id long, host string, fetch_ok boolean, score double, template_hit boolean, garbled_hit boolean, latency double, observed_at timestamp")
    got = queries.whole_search(spark, str(tmp_path)).collect()
    assert {r.item_id for r in got} == {0, 4, 5}
