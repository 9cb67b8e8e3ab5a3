"""Windows of hot anchors come to a shard once, with their number."""

from murmur.llm import substring_dedup

from .conftest import prose
from .test_operators import frame, removed_by_force


def test_equal_windows_of_hot_anchors_are_one_row_of_a_shard(spark, monkeypatch):
    search_shard = substring_dedup._search_shard

    def watched(window):
        search = search_shard(window)

        def once(t):
            keys = t.column("k").to_pylist()
            if len(set(keys)) < len(keys):
                raise ValueError(f"{len(keys)} rows, {len(set(keys))} windows")
            return search(t)

        return once

    monkeypatch.setattr(substring_dedup, "_search_shard", watched)
    shared = prose(999, 40)
    texts = [f"{prose(i, 12, 90000)} {shared} {prose(500 + i, 12, 90000)}" for i in range(60)] + ["a b c d " * 10] * 2
    docs = frame(spark, texts).unionByName(frame(spark, texts[:2]))  # equal rows too
    got = substring_dedup.substring_dedup(docs, window=10, anchor=4, hot_segments=0, shard_words=2000).collect()
    want = removed_by_force([*texts, *texts[:2]], 10)
    assert sorted((x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == sorted(want)
