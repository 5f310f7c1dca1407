import hashlib
import itertools

import public_tokenizers
from tokenizers import Tokenizer

from loomshift.llm import chat, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    quoted = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", quoted), ("assistant", quoted)]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op8_chat(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: digests(v) for k, v in turns.items()}


def test_escaping_is_reversible():
    bits = ["\\", "<", "s>", "/s>", "[", "INST]", "/INST]", "ROLE]", "a", "\n"]
    for n in (1, 2, 3, 4):
        for text in map("".join, itertools.product(bits, repeat=n)):
            assert chat.turns_in("".join(chat.parts_of(text, text)) * 2) == [(text, text)] * 2


def test_shared_turns_are_emitted_once_and_attention_follows_ancestors(spark):
    first = [("user", "hello there")]
    convs = {1: [*first, ("assistant", "one")], 2: [*first, ("assistant", "two"), ("user", "x")], 3: [("user", "other")], 4: [*first, ("assistant", "one")]}
    rows = [(c, i, r, t, "k") for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").coalesce(1)
    seq = chat.trees(frame.repartition(1), PATH).collect()
    assert sum(len(s.node_start) for s in seq) <= 5 + len(seq) - 1
    for s in seq:
        parent = dict(enumerate(s.node_parent))
        node = {p: i for i in range(len(s.node_start)) for p in range(s.node_start[i], s.node_end[i])}
        for i in range(len(s.ids)):
            chain, at = set(), node[i]
            while at >= 0:
                chain.add(at)
                at = parent[at]
            seen = [j for j in range(i + 1) if i < s.interval_end[j]]
            assert seen == [j for j in range(i + 1) if node[j] in chain]
            assert s.positions[i] == len(seen) - 1


def test_ids_equal_the_library_and_long_runs_come_back():
    own, library = chat.tokens(PATH), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = ["", "Hello  world's 12", "日本 é\0x", "<|endoftext|> a\n\n b", "don't  \t x "]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    for t in ["é" * 100_000, "a b" * 900 + "x" * 5000 + " " * 3000 + "y", "\0" * 3000]:
        ids = own.encode([t])[0]
        assert own.decode(ids)[0].decode() == t


def test_turns_whose_parts_join_alike_stay_apart(spark):
    convs = {1: [("user", "x\0y"), ("assistant", "a")], 2: [("user\0x", "y"), ("assistant", "a")], 3: [("us", "er1:x")], 4: [("user", "1:x")], 5: [("", "4:user")], 6: [("user", "")]}
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.trees(frame, PATH), PATH).collect()}
    assert got == {k: digests(v) for k, v in convs.items()}


def test_rows_without_an_id_are_conversations_each(spark):
    frame = spark.createDataFrame([(None, i, "user", f"text {i % 3}") for i in range(50)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.trees(frame, PATH), PATH).collect()
    assert len(got) == 50 and all(r.conv_id is None and r.n_turns == 1 for r in got) and len({r.turns_sha256 for r in got}) == 3


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None, "user", None), (1, 0, None, "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 0, "user", "z"), (2, 0, "user", "é" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.trees(frame, PATH), PATH).collect()}
    want = {1: [("user", ""), ("", "b"), ("assistant", "a"), ("assistant", "a")], None: [("user", "z")], 2: [("user", "é" * 100_000)]}
    assert got == {k: digests(v) for k, v in want.items()}
    assert chat.trees(frame.limit(0), PATH).count() == 0
    small = chat.read_back(chat.trees(frame, PATH, most_tokens=1, most_conversations=1), PATH)
    assert small.count() == 3
