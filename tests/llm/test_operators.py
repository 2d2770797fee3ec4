"""Each corpus operator against brute force, on small tables with nulls, empty and long texts, ties and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import chat, common, decontaminate, jaccard, language, packing, quality, queries, repetition, secrets, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "é", "x " * 9000, "   ", "\U0001f600 ok", "\x00\x1c"]


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# decontamination


def brute_hits(text, items):
    words = decontaminate.words_of(text)
    hit, ids = set(), set()
    for i, t in items:
        w = decontaminate.words_of(t)
        size = min(13, len(w))
        if not size:
            continue
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        for p in range(len(words) - size + 1):
            if tuple(words[p : p + size]) in windows:
                hit |= set(range(p, p + size))
                ids.add("" if i is None else str(i))
    return len(words), len(hit), sorted(ids)


def test_decontamination(spark):
    random.seed(1)
    vocabulary = ["ab", "Cd", "e", "ÿx", "9"]
    text = lambda n: " ".join(random.choice(vocabulary) + random.choice(["", ",", "--"]) for _ in range(n))
    items = [(i, text(random.choice([1, 3, 7, 12, 13, 20, 40]))) for i in range(25)] + [(3, "one two three"), (None, text(15)), (77, None), (78, ""), (79, "...")]
    texts = ODD + [text(random.randint(0, 60)) for _ in range(60)] + [f"{text(5)} {items[i][1]} {text(3)}" for i in range(25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 25, 600):
        found = {r.doc_id: r for r in decontaminate.find(docs(spark, texts), bench, max_bytes=limit).collect()}
        for i, t in enumerate(texts):
            assert (found[i].n_words, found[i].n_hit, list(found[i]["items"])) == brute_hits(t, items), (limit, t)
    assert decontaminate.find(docs(spark, []), bench).count() == 0
    assert decontaminate.find(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_winnowing_keeps_a_fingerprint_of_every_shared_span():
    random.seed(2)
    for _ in range(200):
        grams = np.array([random.randrange(50) for _ in range(30)], np.uint64)
        kept = set(decontaminate.winnow(grams, np.zeros(30, np.int64), 7).tolist())
        assert all(kept & set(range(i, i + 7)) for i in range(24))


# secrets


def brute_spans(text):
    text = text or ""
    cased = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([cased("password"), cased("passwd"), cased("secret"), cased("token"), cased("api") + "_?" + cased("key")])
    out = [("assign", *m.span()) for m in re.finditer("(" + words + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def base62(n):
    out = ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = secrets.BASE62[d] + out
    return out


def test_secrets(spark):
    random.seed(3)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", ": ", "=", " ", "'", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0af" * 9, "é", "ſ", "\n", "deadbeef", "K"]
    texts = ODD + ["".join(random.choice(parts) for _ in range(random.randint(1, 14))) for _ in range(1500)]
    found = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [x for x in found[i] if x[0] in secrets.KINDS[:3]] == brute_spans(t), t


def test_checksums_and_redaction(spark):
    body = "0123456789ABCDEFGHIJabcdefghij"
    good = "ghp_" + body + base62(zlib.crc32(body.encode()))
    words = secrets.automaton()
    assert secrets.scan(f"é {good}.", words) == [("crc_token", 2, 2 + len(good))]
    assert secrets.scan(f"{good[:-1]}{'0' if good[-1] != '0' else '1'}", words) == []
    raw = bytes(range(78))
    whole = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big")
    text = ""
    while whole:
        whole, d = divmod(whole, 58)
        text = secrets.BASE58[d] + text
    assert secrets.base58_holds(text) and not secrets.base58_holds(text[:-1] + ("2" if text[-1] != "2" else "3"))
    assert secrets.bech32_holds("a", "2uel5l") and not secrets.bech32_holds("a", "2uel5m")
    rows = docs(spark, [f"x {good} token=abcdefg y", None, "plain"])
    out = {r.doc_id: r for r in secrets.redact(rows.withColumn("spans", F.lit(1))).collect()}
    assert out[0].text == "x [secret] [secret] y" and out[0].n_chars == len(out[0].text) and out[1].text is None and out[2].text == "plain" and out[0].spans == 1


# language, toxicity, quality


def test_language(spark):
    found = queries.QUERIES["op3_language_id"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(found) == len(truth) and (held.lang == held.lang_pred).mean() > 0.9 and found.score.between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id] == both.held_out.tolist()
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    odd = {r.doc_id: r for r in language.predict(docs(spark, ODD), model, ["doc_id"]).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and odd[0].score == 0 and len(odd) == len(ODD)
    assert language.train(docs(spark, [])) is None and language.predict(docs(spark, ["abc"]), None, ["doc_id"]).first().lang_pred == "und"


def test_language_scores_by_brute_force():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.7)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
        return int(common.mix(np.array([(h + (len(gram) - 1 << 40)) % 2**64], np.uint64))[0] % language.BUCKETS)

    for text in ["abc", "Été über x", "日本 語", "a" * 40]:
        padded = f" {language.prepare(text)} " + " " * language.N_MAX
        found = [bucket(padded[i : i + n]) for i in range(len(padded) - language.N_MAX) for n in range(1, language.N_MAX + 1)]
        want = model.weights[found].astype(float).mean(axis=0) + model.bias
        assert np.allclose(model.logits([language.prepare(text)])[0], want, atol=1e-5), text


def test_toxicity_scores_by_brute_force():
    weight = np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32)

    def bucket(gram):
        if len(gram) > toxicity.N_MAX:
            codes = np.array([ord(c) for c in gram])
            return int(common.range_hashes(codes, np.array([0]), np.array([len(codes)]))[0] % np.uint64(toxicity.BUCKETS))
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
        return int(common.mix(np.array([h], np.uint64))[0] % toxicity.BUCKETS)

    texts = [toxicity.prepare(t) for t in ["idiot", "An absolutely worthless, Été!", "", "a b  日本語の長い言葉です"]]
    scores = toxicity.Model(weight, 0.3).scores(texts)
    for text, score in zip(texts, scores):
        words = [f" {w} " for w in text.split()]
        grams = [w[i : i + n] for w in words for n in range(toxicity.N_MIN, toxicity.N_MAX + 1) for i in range(len(w) - n + 1)] + [w for w in words if len(w) > toxicity.N_MAX]
        mean = np.mean([weight[bucket(g)] for g in grams]) if grams else 0.0
        assert abs(score - 1 / (1 + np.exp(-(mean + 0.3)))) < 1e-5, text


def test_quality_scores_by_brute_force():
    rng = np.random.default_rng(3)
    bags = quality.bags_of([" ".join(rng.choice(["a", "B!!", "ccc", "#$"], size=n)) for n in (0, 5, 64, 65, 200)])
    model = quality.fit(bags, np.array([0, 1, 0, 1, 0]))
    p = model.weights
    for bag, score in zip(bags, model.scores(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]))):
        codes, weights = [], []
        for passage in bag:
            h = np.tanh((passage - model.center) / model.scale @ p["W"] + p["b"])
            codes.append(h)
            weights.append(np.exp(float((np.tanh(h @ p["V"]) / (1 + np.exp(-h @ p["U"]))) @ p["w"])))
        z = sum(w * h for w, h in zip(weights, codes)) / sum(weights)
        assert abs(score - 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))) < 1e-9


@pytest.mark.parametrize("sf, precision, recall, right", [("sf0.01", 0.6, 0.5, 0.97), ("sf0.1", 0.85, 0.85, 0.99)])
def test_held_out_accuracy(sf, precision, recall, right):
    import duckdb

    def rows(label):
        both = f"'/root/testdata/{sf}/labels.parquet' JOIN '/root/testdata/{sf}/documents.parquet' USING (doc_id)"
        found = duckdb.sql(f"SELECT doc_id, text, {label} FROM {both} WHERE text IS NOT NULL AND {label} IS NOT NULL ORDER BY doc_id").fetchall()
        held = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in found])
        return [r[1] for r in found], np.array([r[2] for r in found]), held

    texts, y, held = rows("toxic")
    texts = [toxicity.prepare(t) for t in texts]
    model = toxicity.fit([t for t, h in zip(texts, held) if not h], y[~held])
    said = model.scores([t for t, h in zip(texts, held) if h]) >= toxicity.THRESHOLD
    hits = (said & (y[held] == 1)).sum()
    assert hits >= precision * said.sum() and hits >= recall * (y[held] == 1).sum()
    texts, y, held = rows("quality")
    bags = quality.bags_of(texts)
    model = quality.fit([b for b, h in zip(bags, held) if not h], y[~held])
    mine = [b for b, h in zip(bags, held) if h]
    said = model.scores(np.concatenate(mine), np.concatenate([[0], np.cumsum([len(b) for b in mine])])) >= quality.THRESHOLD
    assert (said == (y[held] == 1)).mean() >= right


def test_ftrl_is_sparse_and_temperature_calibrates():
    random.seed(4)
    rows = [(np.array([i % 3, 3 + random.randrange(500), language.BUCKETS]), np.array([1.0, 1.0, 1.0])) for i in range(300)]
    weights, _ = language.ftrl(rows, np.array([i % 3 for i in range(300)]), 3)
    assert weights[:3].argmax(axis=1).tolist() == [0, 1, 2] and (weights[600:] == 0).all()
    logits = np.array([[4.0, 0.0]] * 100)
    y = np.array([0] * 73 + [1] * 27)
    assert abs(language.softmax(logits[:1] / language.temperature(logits, y))[0, 0] - 0.73) < 0.02


def test_toxicity_learns_misspellings():
    random.seed(5)
    plain = ["river", "stone", "window", "yellow", "garden", "morning", "paper"]
    text = lambda bad: " ".join(random.choices(plain, k=20) + ([random.choice(["worthless", "worthles", "worthlesss"])] if bad else []))
    y = np.array([i % 4 == 0 for i in range(400)], np.int64)
    model = toxicity.fit([toxicity.prepare(text(b)) for b in y], y)
    a, b = model.scores([toxicity.prepare("river stone wortthless garden paper window")]), model.scores([toxicity.prepare("river stone garden paper window")])
    assert a[0] > 0.5 > b[0]
    assert toxicity.fit([], np.array([], np.int64)) is None


def test_bags_hold_word_ngrams_with_borders():
    found, starts = toxicity.bag(["ab cde", ""])
    grams = {f" {w} "[i : i + n] for w in ("ab", "cde") for n in range(3, 9) for i in range(len(w) + 3 - n)}
    assert starts[1] == len(grams) and starts[2] == starts[1]
    assert len(toxicity.bag(["abcdefgh"])[0]) == sum(11 - n for n in range(3, 9)) + 1  # and the word as a whole


def test_classifier_queries(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, least in (("op6_quality", 0.7), ("op7_toxicity", 0.3)):
        found = queries.QUERIES[name](spark, SF).toPandas()
        assert len(found) == n and found.score.between(0, 1).all() and (found.predicted == (found.score >= least)).all()
    empty = quality.score(docs(spark, ODD), quality.fit(quality.bags_of(["a b", "A!! B!!"] * 20), np.array([1, 0] * 20)))
    assert empty.count() == len(ODD) and toxicity.score(docs(spark, ODD), None).where("score <> 0").count() == 0


def test_attention_gradients():
    random.seed(6)
    bags = quality.bags_of([" ".join(random.choices(["a", "B!!", "ccc", "#$"], k=random.randint(0, 200))) for _ in range(6)])
    y = np.array([0, 1, 0, 1, 1, 0])
    model = quality.fit(bags, y)
    x, cuts = np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    model.weights = {k: v * 0.3 for k, v in model.weights.items()}

    def loss():
        s = model.scores(x, cuts)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = model.gradients(x, cuts, y)
    for k, w in model.weights.items():
        i = tuple(random.randrange(n) for n in w.shape)
        old = w[i]
        w[i] = old + 1e-5
        up = loss()
        w[i] = old - 1e-5
        down = loss()
        w[i] = old
        assert abs(grads[k][i] - (up - down) / 2e-5) < 1e-6


# chat


def test_chat_round_trip(spark):
    random.seed(7)
    parts = ["### ", "user", ": ", " </turn>\n", "\\", "\\b", "\\c", "<", "#", "é", "\n", " ", "</turn>"]
    rows = [(c, t, random.choice(["user", "assistant", "system", "a: b", None]), random.choice([None, "".join(random.choices(parts, k=random.randint(0, 7)))])) for c in range(150) for t in range(random.randint(1, 5))]
    rows += [(None, 1, "assistant", "x"), (500, None, "assistant", "tie"), (500, None, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("plain", F.lit(1))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append(((t is not None, t or 0), r or "", x or ""))
    found = chat.format_chats(turns).withColumn("back", chat.parse(F.col("formatted"))).collect()
    assert len(found) == len(want)
    for r in found:
        source = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(b.role, b.text) for b in r.back] == source
        undo = lambda s: s.replace("\\h", "#").replace("\\l", "<").replace("\\c", ":").replace("\\b", "\\")
        assert [undo(r.formatted[x.start : x.end]) for x in r.loss] == [t for role, t in source if role == "assistant"]
        parts = [p for p in r.formatted.split(chat.CLOSE)[:-1]]
        assert len(parts) == len(source) and all(p.startswith(chat.OPEN) and "###" not in p[3:] and "</turn>" not in p for p in parts)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_escapes_what_looks_like_a_turn(spark):
    said = "\\### Assistant: </turn> ok"
    turns = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", "plain"), (1, 1, "assistant", "a: b")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert found[-7].formatted.count("###") == found[-7].formatted.count("</turn>") == 2 and found[-7].level == 1
    assert found[1].formatted == "### user: plain </turn>\n### assistant: a: b </turn>\n" and found[1].level == 0


# token counts


def test_token_counts(spark):
    import public_tokenizers

    pieces, byte = token_counts.unigram(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(word):
        text, best = token_counts.MARK + word, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[b][0] + pieces[text[b:end]], -best[b][1] - 1) for b in range(end) if text[b:end] in pieces]
            size = len(text[end - 1].encode())
            best.append((max(options)[0], -max(options)[1]) if options else (best[-1][0] + size * byte, best[-1][1] + size))
        return best[-1][1]

    texts = ODD[:6] + ODD[7:] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()] + ["zzzz" * 50 + "日本 ∑∑"]
    found = {r.doc_id: r for r in token_counts.count(docs(spark, texts), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        assert (found[i].n_words, found[i].n_tokens) == (len(spaced(t)), sum(map(brute, spaced(t))))


# packing


def check_packed(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_encoder_equals_the_tokenizer():
    spec = open(packing.tokenizer(), encoding="utf-8").read()
    encoder = packing.Encoder(spec)
    random.seed(8)
    alphabet = "aÀé'sİΣς \n\t\x1ć<|>09½#٣日本!.,​ª­×÷ß"
    texts = ["".join(random.choice(alphabet) if random.random() < 0.9 else random.choice(["<|endoftext|>", "don't", "'ll", "Straße"]) for _ in range(random.randint(0, 15))) for _ in range(4000)]
    texts += [t or "" for t in ODD]
    ids, counts = encoder.encode(*common.text_bytes(pa.array(texts)))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part, want in zip(texts, parts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert part.tolist() == want.ids, text


def test_packing(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = packing.pieces(docs(spark, texts), packing.tokenizer())
    rows = packing.pack(found).collect()
    n, total = check_packed(rows), sum(r.length for r in rows)
    assert len(rows) == found.count() and n == -(-total // 2048)
    encoder = packing.Encoder(open(packing.tokenizer(), encoding="utf-8").read())
    by = defaultdict(dict)
    for r in rows:
        by[r.doc_id][r.piece] = r
    for i, t in enumerate(texts):
        ids = [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        got = [by[i][k] for k in range(len(by[i]))]
        assert [(g.start, g.length, g.ids_crc32) for g in got] == [(2048 * k, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for k, w in enumerate(want)]
    small = packing.pack(found, part_rows=20).collect()
    assert len(small) == len(rows) and check_packed(small) <= n + 3
    assert packing.pack(found.limit(0)).count() == 0


def test_packing_goes_on_while_sequences_are_saved(spark, monkeypatch):
    random.seed(10)
    found = spark.createDataFrame([(i, 0, 0, random.randint(250, 1100), 0) for i in range(2000)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    turns, pack_round = [], packing._round
    monkeypatch.setattr(packing, "_round", lambda rows, n, turn, capacity: turns.append(turn) or pack_round(rows, n, turn, capacity))
    whole = packing.pack(found, part_rows=20).collect()
    assert len(whole) == 2000 and max(turns) > 4
    # how rows are dealt decides in which round the last sequence is saved, so rounds are compared loosely but the first
    early, four = (check_packed(packing.pack(found, part_rows=20, max_rounds=n).collect()) for n in (1, 4))
    assert check_packed(whole) < early and check_packed(whole) <= four <= early


def test_bounds_and_best_fit():
    random.seed(9)
    for _ in range(60):
        capacity = random.choice([10, 30, 100])
        sizes = np.array([random.randint(1, capacity) for _ in range(random.randint(1, 40))])
        bins, offsets, n = packing.best_fit(sizes, capacity)
        assert packing.lower_bound(sizes, capacity) <= n and np.bincount(bins, weights=sizes).max() <= capacity
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4, 4, 4, 4, 4]), 10) == 3


# repetition


def brute_repetition(text, least=repetition.LEAST):
    text = text or ""
    w = spaced(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)

    def marked(k):
        counts = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return {j for i in range(len(w) - k + 1) if counts[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}

    longest = max([k for k in range(least, len(w)) if marked(k)], default=0)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked(3)), len(marked(least)), longest


def test_quality_rules(spark):
    random.seed(10)
    words = ["a", "b", "é#", "dd", "e"]
    texts = [t for t in ODD if not t or len(t) < 1000]
    for _ in range(400):
        k = random.randint(1, 5)
        texts.append("".join(random.choice(words[:k]) + random.choice([" ", "\n", "  ", "\t"]) for _ in range(random.randint(0, 45))))
    found = {r.doc_id: r for r in repetition.rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(found[i][f] for f in repetition.FIELDS) == brute_repetition(t), t
        assert found[i].base_failed == (found[i].n_words < 50 or 100 * found[i].n_repeat_words > 50 * found[i].n_words)
        assert not (found[i].kept and found[i].base_failed)
    long = repetition.rules(docs(spark, ["x " * 9000])).first()
    assert (long.n_covered, long.longest_repeat, long.kept) == (9000, 8999, False)


def test_the_method_decides_what_the_base_rules_keep(spark):
    random.seed(15)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    unique = lambda n: [word() for _ in range(n)]
    texts = []
    for block, rest in [(0, 80), (7, 90), (8, 90), (20, 100), (20, 25), (30, 40), (30, 62), (60, 300), (201, 1500), (200, 1500), (199, 1500)] + [(random.randint(5, 40), random.randint(30, 120)) for _ in range(60)]:
        b, r = unique(block), unique(rest)
        texts.append(" ".join([*r[: rest // 2], *b, *r[rest // 2 :], *b]))
    verdicts = Counter()
    found = {r.doc_id: r for r in repetition.rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, *_, repeated, covered, longest = brute_repetition(t)
        base = n < 50 or 100 * repeated > 50 * n
        assert (found[i].base_failed, found[i].kept) == (base, not base and covered <= repetition.MAX_COVERED * n and longest <= repetition.MAX_REPEAT), t
        verdicts[base, found[i].kept] += 1
    assert verdicts[False, False] > 5 and verdicts[False, True] > 5 and verdicts[True, False] > 5


def test_long_texts_give_the_same_repeats(monkeypatch):
    random.seed(16)
    texts = [" ".join(random.choices(["a", "b", "cc", "d"][: random.randint(1, 4)], k=random.randint(0, 60))) for _ in range(80)]
    whole = repetition.measure(*common.text_bytes(pa.array(texts)), texts)
    monkeypatch.setattr(repetition, "MANY", 0)
    alone = repetition.measure(*common.text_bytes(pa.array(texts)), texts)
    assert all((whole[f] == alone[f]).all() for f in repetition.FIELDS)


# Jaccard join


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = spaced(lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("hot", [2, 32])
def test_near_links_lists_every_link(spark, hot):
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefgh", k=3))
    texts = list(ODD)
    for b in [[word() for _ in range(n)] for n in (3, 20, 40, 80)]:
        for _ in range(8):
            c = list(b)
            for _ in range(random.choice([0, 1, 2])):
                c[random.randrange(len(c))] = word()
            texts.append(" ".join(c))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := spaced(lower(t))) else set() for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if (n := len(sets[i] & sets[j])) and 100 * n >= 75 * len(sets[i] | sets[j])}
    found, members = jaccard.near_links(docs(spark, texts), hot_from=hot)
    rep = {r.doc_id: r.rep for r in members.collect()}
    pairs = {tuple(r) for r in found.collect()}
    assert {(i, j) for j in rep for i in rep if i < j and (rep[i] == rep[j] or (min(rep[i], rep[j]), max(rep[i], rep[j])) in pairs)} == want
    assert len(want) > len(texts) and all(a < b and {a, b} <= set(rep.values()) for a, b in pairs)


@pytest.mark.parametrize("hot, block", [(2, 3), (5, 1024), (32, 3)])
def test_near_duplicates(spark, hot, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "STAR", block)
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=3))
    base = [[word() for _ in range(random.choice([3, 12, 40, 80]))] for _ in range(12)]
    common_part = [word() for _ in range(30)]
    texts = list(ODD)
    for b in base:
        for _ in range(random.choice([1, 4, 14])):
            w = list(b)
            for _ in range(random.randint(0, 6)):
                w[random.randrange(len(w))] = word()
            texts.append(" ".join(w if random.random() < 0.7 else common_part + w))
        texts.append(" ".join(b).upper())
    ids = random.sample(range(1000), len(texts))
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("id", F.lit(5)).repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows, hot_from=hot).collect()}
    assert found == brute_components(ids, texts)


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    assert {tuple(r) for r in jaccard.near_duplicates(docs(spark, [None, "", "a", "A"])).collect()} == {(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2)}


def test_adaptive_prefix_holds_fewer_hot_tokens_than_matches_required():
    random.seed(12)
    for _ in range(300):
        n = random.randint(1, 60)
        hot = np.array([random.random() < 0.4 for _ in range(n)])
        level = jaccard.adaptive(np.arange(n), hot)
        size = n - jaccard.need(n)
        if level:
            assert hot[: size + level].sum() < level and all(hot[: size + k].sum() >= k for k in range(1, level))
        else:
            assert all(hot[: size + k].sum() >= k for k in range(1, jaccard.need(n) + 1))


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9])
def test_marks_never_rule_out_a_link(spark, share):
    random.seed(13)
    texts = [" ".join(random.choices("abcdefghij", k=random.randint(5, 90))) for _ in range(30)]
    texts += [" ".join(w if random.random() < 0.97 else "zz" for w in random.choice(texts).split()) for _ in range(40)]
    tokens, cuts = jaccard.shingles(*common.text_bytes(pa.array(texts)))
    hot = np.array([t for t in np.unique(tokens) if random.random() < share], np.uint64)
    found = jaccard.second_pass(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), hot).collect()
    marks = {r.id: jaccard.Mark(r.n, bytes(r.map)) for r in found}
    whole = {r.id: jaccard.Whole(tokens[cuts[r.id] : cuts[r.id + 1]].tobytes(), r.level) for r in found}
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            x, y = set(tokens[cuts[i] : cuts[i + 1]].tolist()), set(tokens[cuts[j] : cuts[j + 1]].tolist())
            if 100 * len(x & y) >= 75 * len(x | y):
                linked += 1
                assert marks[i].may_link(marks[j]) and marks[j].may_link(marks[i])
            assert whole[i].may_link(whole[j]) == whole[j].may_link(whole[i]) == (100 * len(x & y) >= 75 * len(x | y))
    assert linked > 10 and (share < 0.5 or max(w.level for w in whole.values()) > 1)


def brute_rows(rows):
    """Component of each row (id, text): rows of one id are one node, a null id is a node of its own."""
    near = brute_components(list(range(len(rows))), [t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        root[find(i)] = find(near[i][1])
        for j in range(i):
            if a is not None and a == rows[j][0]:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (a, _) in enumerate(rows):
        ids[find(i)].append(a)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((a, near[i][0], least[find(i)]) for i, (a, _) in enumerate(rows))


def test_rows_of_one_id_are_one_node(spark):
    random.seed(14)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    base = {k: " ".join(word() for _ in range(60)) for k in "ABCDE"}
    rows = [(3, base["A"]), (5, base["A"]), (5, base["B"]), (9, base["B"] + " zz"), (20, base["B"]), (None, base["B"]), (None, base["E"]), (None, None)]
    rows += [(30, base["C"]), (30, base["D"]), (30, base["C"]), (31, None), (31, base["D"]), (40, None), (40, None), (-7, base["E"] + " yy")]
    for row in list(rows):
        rows.append((random.choice([3, 9, 50, 51, None]), row[1] and row[1].replace(row[1].split()[7], word())))
    clashing = {c: F.lit(1) for c in ("_one", "component_id", "id", "n", "row", "name", "component")}
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing)).collect()
    assert Counter(map(tuple, found)) == brute_rows(rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
