import hashlib
import random
import re
from datetime import date

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lexarium.llm import bpe_piece, license_join, packing, pii_feistel
from lexarium.llm.common import written
from lexarium.llm import queries as llm

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {t: k for k, t in enumerate(bpe_piece.ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(5)
    made = ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0x20, 0x2FFF), r.randrange(0x1F300, 0x1F6FF), 32, 10))) for _ in range(200)) for _ in range(60)]
    return [*made, "", "don't I'll 'S", "a  b   \n\n c\t", "x" * 3000, "\x00\x1c\x85　", "日本語 😀👍🏽"]


def test_bpe_equals_the_library(library, texts):
    bpe = bpe_piece.coder(PATH, P.PATTERN)
    for text, ids in zip(given := [*odd_texts(), *texts[:40]], bpe.encode_many(given)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_bpe_every_token_is_reached():
    bpe = bpe_piece.coder(PATH, P.PATTERN)
    step = range(0, len(bpe.tokens), 97)
    assert all(bpe.model.encode(bpe_piece.as_chars(bpe.tokens[k])) == [k] for k in step)


def test_bpe_long_text_in_parts(library):
    text = "some words, and more. " * 40_000
    assert np.frombuffer(bpe_piece.coder(PATH, P.PATTERN).encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_frame(awkward, empty):
    rows = bpe_piece.encoded(awkward, PATH, P.PATTERN).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect() if r["doc_id"] is not None}
    assert len(rows) == awkward.count()
    for r in rows:
        assert hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] and 4 * r["n_tokens"] == len(r["ids"])
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe_piece.encoded(empty, PATH, P.PATTERN).count() == 0


def brute_rows(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def test_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(150):
        capacity = r.choice((1, 2, 7, 64, 100))
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(k for row in rows for k in row) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[k] for k in row) for row in rows) == brute_rows(lengths, capacity)


def unpacked(rows, length):
    docs = {}
    for r in rows:
        ids, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        ends = r["cu_seqlens"]
        assert len(ids) == length and ends[0] == 0 and ends[-1] == r["n_tokens"] <= length
        assert (ids[ends[-1] :] == packing.PAD).all()
        for a, b, doc, start in zip(ends, ends[1:], r["doc_ids"], r["doc_starts"]):
            assert positions[a:b].tolist() == list(range(b - a))
            docs.setdefault(doc, []).append((start, ids[a:b].tolist()))
    return {d: [x for _, part in sorted(parts) for x in part] for d, parts in docs.items()}


def test_packing_loses_nothing(numbered, texts, library):
    rows = packing.pack(numbered, llm.encoder, length=64, chunk_tokens=3000).collect()
    assert len({r["pack_id"] for r in rows}) == len(rows)
    assert unpacked(rows, 64) == {k: library.encode_ordinary(t) for k, t in enumerate(texts) if t}
    full = sum(r["n_tokens"] for r in rows) / (64 * len(rows))
    assert full > 0.9


def test_packing_awkward(awkward, empty, library):
    rows = packing.pack(awkward, llm.encoder, length=128).collect()
    got = unpacked(rows, 128)
    assert got[7] == library.encode_ordinary("x" * 30_000 + " y") and None in got and not {3, 4} & set(got)
    assert packing.pack(empty, llm.encoder).count() == 0
    with pytest.raises(ValueError, match="length"):
        packing.pack(empty, llm.encoder, length=0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    p = pii_feistel.Permutation(b"key", "d", n)
    assert sorted(map(p, range(n))) == list(range(n)) and all(p.inverse(p(k)) == k for k in range(n))


def test_pseudonyms_keep_formats():
    names = pii_feistel.Pseudonyms(b"k")
    text = "Mail an.b@mail9.example.com, +1 (377) 555-0271, card 4929348385146306 and 4929 3483 8514 6306; 161.17.88.162. 2021-02-28 31.12.1999 12/25/2020 123-45-6789 DE89 3704 0044 0532 0130 00!"
    new, spans = names.rewrite(text)
    kinds = [k for _, _, k in spans]
    assert kinds == ["email", "phone", "card", "card", "ip", "date", "date", "date", "ssn", "iban"]
    got = [new[a:b] for a, b, _ in spans]
    assert got[0].endswith("@mail9.example.com") and got[1].startswith("+1 (") and len(got[1]) == 17
    assert got[2] == got[3].replace(" ", "") and pii_feistel.luhn_digit(got[2][:-1]) == got[2][-1]
    assert all(int(x) < 256 for x in got[4].split("."))
    date.fromisoformat(got[5])
    plain = got[9].replace(" ", "")
    assert pii_feistel.iban_digits(plain[:2], plain[4:]) == plain[2:4]
    assert not set(got) & set(text.split()) and new != text
    assert names.rewrite(text) == (new, spans) and pii_feistel.Pseudonyms(b"other").rewrite(text)[0] != new


@pytest.mark.parametrize("text", ["9807915762804490", "2021-02-29", "10.0.0.300", "1.2.3", "version 4.0.", "000-12-3456", "no data here", "a@b", "page 12345678901234567890123", "@" * 50])
def test_what_does_not_validate_stays(text):
    assert pii_feistel.Pseudonyms(b"k").rewrite(text) == (text, [])


@pytest.mark.parametrize(
    "text, kinds, left",
    [
        ("Card 4111 1111 1111 1111 12/27", ["card"], " 12/27"),
        ("Card 4111111111111111 123", ["card"], " 123"),
        ("call 555-123-4567 555-987-6543", ["phone", "phone"], ""),
        ("BE68539007547034 EUR 20", ["iban"], " EUR 20"),
        ("2024-01-15T10:30:00Z", ["date"], "T10:30:00Z"),
        ("tel +49 30 1234567, +49 (0)30 123456 or 06 12 34 56 78", ["phone", "phone", "phone"], ""),
        ("Call 5551234567 now", ["phone"], " now"),
        ("fax: 030/1234567 12 pages", ["phone"], " 12 pages"),
        ("+1 555-123-4567 2020", ["phone"], " 2020"),
        ("user@m\u00fcller.de, J\u00fcrgen.x@web.de; a@b.de", ["email", "email", "email"], "@b.de"),
        ("from 2001:db8::8a2e:370:7334 and fe80::1", ["ip", "ip"], ""),
        ("on 3 April 2020, May 21st, 1999 and le 14 juillet 1989, am 3. M\u00e4rz 2001, 2 de abril de 2010", ["date"] * 5, ""),
        ("1/2/2020 3.4.2020 31/12/99", ["date", "date", "date"], ""),
        ("at 2024-01-15T10:30:00Z from 161.17.88.162 and 2024-01-16T10:30", ["date", "ip", "date"], "T10:30"),
    ],
)
def test_values_next_to_others(text, kinds, left):
    new, spans = pii_feistel.Pseudonyms(b"k").rewrite(text)
    assert [k for _, _, k in spans] == kinds and new.endswith(left) and len(spans) == len({new[a:b] for a, b, _ in spans})
    assert all(new[a:b] not in text for a, b, _ in spans)


@pytest.mark.parametrize("text", ["1/2/2020", "3.4.2020", "12/31/1999", "2021-02-28", "9/9/09", "10.0.0.255", "1.2.3.4", "a@b.de", "Zo\u00eb@x.org", "\u0418\u0432\u0430\u043d@x.org", "+49 30 1234567", "fe80::1", "2001:0db8:0:1:2:3:4:ff", "123-45-6789", "4111 1111 1111 1111"])
def test_pseudonyms_have_the_same_length_and_validate_again(text):
    """Under many keys: as long, not the value itself, one to one, and personal data again."""
    for k in range(40):
        names = pii_feistel.Pseudonyms(bytes([k + 1]))
        new, spans = names.rewrite(text)
        assert len(new) == len(text) and new != text and spans == [(0, len(text), spans[0][2])]
        assert names.rewrite(new)[1] == spans


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_moved_leaves_nothing_in_place(n):
    p = pii_feistel.Permutation(b"key", "d", n)
    assert sorted(map(p.moved, range(n))) == list(range(n)) and all(p.moved(k) != k for k in range(n))


def test_a_date_is_the_same_in_every_way_of_writing():
    names = pii_feistel.Pseudonyms(b"k")
    iso = date.fromisoformat(names.rewrite("2020-04-03")[0])
    assert names.rewrite("3.4.2020")[0] == f"{iso.day}.{iso.month}.{iso.year}" and names.rewrite("04/03/2020")[0] == f"{iso:%m/%d/%Y}"
    assert names.rewrite("3 April 2020")[0] == f"{iso.day} {pii_feistel.MONTHS['en'][iso.month - 1].capitalize()} {iso.year}"


def valid_values(text):
    """A plain scanner: every stretch of up to six words that is a valid value by itself, judged by other means than the operator's."""
    import datetime
    import ipaddress

    def luhn(digits):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(x // 10 + x % 10 for x in doubled) % 10 == 0

    def valid(s):
        plain = s.replace(" ", "").replace("-", "")
        if re.fullmatch("[0-9](?:[ -]?[0-9]){12,18}", s) and luhn(plain) and len(set(plain)) > 1:
            return True
        if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9 ]+", s) and 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and re.fullmatch("[A-Z0-9]{4}( [A-Z0-9]{4})*( [A-Z0-9]{1,3})?|[A-Z0-9]+", s):
            return True
        try:
            ipaddress.ip_address(s)
            return True
        except ValueError:
            pass
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y", "%d %B %Y", "%B %d, %Y"):
            try:
                if 1900 <= datetime.datetime.strptime(s, form).year < 2100:
                    return True
            except ValueError:
                pass
        return bool(re.fullmatch(r"[\w.+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}", s) or re.fullmatch(r"\+[0-9]{1,3} [0-9]{2,4} [0-9]{6,7}", s))

    words = [(m.start(), m.end()) for m in re.finditer("[^ ,;]+", text)]
    return [(words[i][0], words[j][1]) for i in range(len(words)) for j in range(i, min(i + 9, len(words))) if valid(text[words[i][0] : words[j][1]])]


def test_no_valid_value_is_left():
    """Against the plain scanner: what it finds in the original overlaps a span, and nothing else of the text changes."""
    r = random.Random(11)
    names = pii_feistel.Pseudonyms(b"k")
    some = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def value():
        card = some(15)
        account = some(18)
        made = (
            card + pii_feistel.luhn_digit(card), "DE" + pii_feistel.iban_digits("DE", account) + account, ".".join(str(r.randrange(256)) for _ in range(4)),
            f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"{r.randrange(1, 13)}/{r.randrange(1, 29)}/{r.randrange(1950, 2049)}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1950, 2049)}",
            f"{r.randrange(1, 29)} {pii_feistel.MONTHS['en'][r.randrange(12)].capitalize()} {r.randrange(1950, 2049)}", f"u{some(3)}.x@mail{some(1)}.example.org", f"2001:db8::{some(3).lstrip('0') or 1}:ff", f"+49 {some(3)} {some(7)}",
        )
        return r.choice(made)

    def junk():
        return r.choice(("alpha", "Beta", "no", some(r.randint(1, 5)), "v" + some(2), some(2) + "%", "x" + some(16), "$" + some(4)))

    for _ in range(300):
        text = r.choice((" ", ", ", "; ")).join(value() if r.random() < 0.4 else junk() for _ in range(r.randint(1, 10)))
        covered = [(a, b) for a, b, _, _ in names.found(text)]
        new, _ = names.rewrite(text)
        kept = [text[a:b] for (_, a), (b, _) in zip([(0, 0), *covered], [*covered, (len(text), 0)])]
        assert re.fullmatch(".+?".join(map(re.escape, kept)), new), text
        for a, b in valid_values(text):
            assert any(x < b and a < y for x, y in covered), (text, text[a:b])


def test_long_text_without_end():
    text = "a" * 300_000 + "@" + "1-" * 100_000
    assert pii_feistel.Pseudonyms(b"k").rewrite(text)[1] == []


def test_pseudonyms_link_documents(spark, awkward, empty):
    rows = [(1, "call 161.17.88.162"), (2, "again 161.17.88.162 twice"), (3, None)]
    found = {r["doc_id"]: r for r in pii_feistel.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    values = [found[k]["text"][found[k]["spans"][0]["start"] : found[k]["spans"][0]["end"]] for k in (1, 2)]
    assert values[0] == values[1] != "161.17.88.162" and found[3]["text"] is None and found[3]["n_found"] == 0
    assert pii_feistel.pseudonymised(awkward, b"k").count() == awkward.count() and pii_feistel.pseudonymised(empty, b"k").count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or",
    "apache-2": "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
}


def brute_licenses(text):
    """Every block of every notice, without any filter."""
    import re

    words = re.findall(license_join.WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    starts, base, blocks = [], set(), []
    for phrase, label in license_join.PHRASES:
        parts = phrase.split()
        own = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        starts += own
        base |= {label} if own else set()
    for notice, label, must in license_join.NOTICES:
        own, length = set(notice.split()), -(-5 * len(notice.split()) // 4)
        held = [(own & set(words[k : k + length]), -k) for k, w in enumerate(words) if w in own]
        n, less = max(((len(x), k) for x, k in held if set(must.split()) <= x), default=(0, 0))
        if n >= license_join.need(len(own)):
            blocks.append((-less, label, n / len(own)))
    best = 1.0 if starts else max((b[2] for b in blocks), default=0.0)
    labels = ",".join(sorted({b[1] for b in blocks} | base))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, best, sorted(blocks)


def test_licenses_equal_brute_force(spark, awkward, empty):
    r = random.Random(8)
    texts = list(WRAPPED.values())
    texts += ["Released under the MIT License.", "Under THE mit\nlicense", "Apache License, Version 2", "CC-BY-NC cc by nc cc by nc", "m\u0130t \u212aK license"]
    notices = [n.split() for n, *_ in license_join.NOTICES]
    for k in range(150):
        own = r.choice(notices)
        kept = [x for w in own if r.random() < r.choice((0.7, 0.85, 1.0)) for x in ([w] if r.random() < 0.9 else [w, r.choice(("other", "\n", "the"))])]
        if k % 3 == 0:
            r.shuffle(kept)
        around = [r.choice(("alpha", "the", "license", "\n", "\u00fcnder", "gnu", *own)) for _ in range(r.randint(0, 60))]
        texts.append(" ".join(w.upper() if r.random() < 0.1 else w for w in around + kept + ["end", "of", "it"] * r.randint(0, 9)))
    apart = " ".join(w + " filler" * 9 for w in notices[7])
    texts += [apart, None, "", "the of a license " * 20_000 + "released under the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {row["doc_id"]: row for row in license_join.licenses(df).collect()}
    names = "n_words n_base first_word last_word base_labels labels score".split()
    for k, text in enumerate(texts):
        assert (*(rows[k][n] for n in names), [tuple(b) for b in rows[k]["blocks"]]) == brute_licenses(text), text
    for k, label in enumerate(WRAPPED):
        assert label in rows[k]["labels"].split(",")
    assert rows[texts.index(apart)]["labels"] == ""
    assert license_join.licenses(awkward).count() == awkward.count() and license_join.licenses(empty).count() == 0


def brute_links(text):
    """Every block that holds enough of a notice, with that notice."""
    words = re.findall(license_join.WORDS, (text or "").lower())
    found = []
    for notice, label, must in license_join.NOTICES:
        own, length = set(notice.split()), license_join.length(notice)
        for k, w in enumerate(words):
            held = own & set(words[k : k + length])
            if w in own and set(must.split()) <= held and len(held) >= license_join.need(len(own)):
                found.append((k, label, len(held) / len(own)))
    return sorted(found)


def test_every_link_of_a_license_join(spark, tmp_path):
    """A notice that stands in a text many times is linked at each of its places, in the operator and in the query, as in SQL."""
    import duckdb

    r = random.Random(9)
    short, gnu = "released under the MIT license", WRAPPED["gpl"]
    texts = [f"{short} and once more {'filler ' * 20}\n{short}", f"{gnu}\n{'other ' * 40}{gnu}\n{short}", "nothing here", "", None, f"{short} " * 300]
    texts += [" ".join(x for n, *_ in r.choices(license_join.NOTICES, k=4) for x in [*(w for w in n.split() if r.random() < 0.9), *["between"] * r.randint(0, 30)]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x for x in license_join.licenses(df.repartition(3)).collect()}
    for k, text in enumerate(texts):
        assert [tuple(b) for b in found[k]["links"]] == brute_links(text), text
        assert set(found[k]["blocks"]) <= set(found[k]["links"])
    places = [b["word"] for b in found[0]["links"] if b["label"] == "mit" and b["containment"] == 1]
    assert {0, 28} <= set(places) and len(found[5]["links"]) > 300
    df.write.parquet(str(tmp_path / "documents.parquet"))
    query = llm.op7_license_links(spark, str(tmp_path))
    rows = sorted(map(tuple, query.collect()))
    documents = duckdb.read_parquet(f"{tmp_path}/documents.parquet/*.parquet")  # noqa: F841
    oracle = duckdb.sql(llm.oracle_sql()["op7_license_links"])
    assert rows == sorted(oracle.select(*query.columns).fetchall()) and rows[0][query.columns.index("n_links")] == len(brute_links(texts[0]))


def test_short_notices_need_their_telling_words(spark):
    texts = ["Released under the BSD License.", "Released under the Apache License, Version 2.0.", "Licensed under CC BY 4.0.", "CC BY-SA 4.0", "Licensed under CC BY-NC 4.0", "Released under the MIT licence, the license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in license_join.licenses(df).orderBy("doc_id").collect()] == ["", "apache-2", "", "", "cc-by-nc", "mit"]


def test_licenses_run_no_python(numbered, monkeypatch):
    """Nor do the tables that it writes on the way."""
    plans = []

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(license_join, "written", watched)
    plans.append(license_join.licenses(numbered)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3
    for plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
