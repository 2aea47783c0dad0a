"""Cases of the second round's advice: what the operators did less than whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallywind.llm import chat, licenses, main_text, packing, queries, secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts)], SCHEMA)


def ids_of(rows, doc):
    pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
    return np.frombuffer(b"".join(r.tokens for r in pieces), "<u4").tolist()


def contract_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_knows_the_added_token(spark, tmp_path):
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b  <|endoftext|>\n", "<|endoftext| > x <|ENDOFTEXT|>", "it's   <|endoftext|>'s"]
    reference = contract_tokenizer()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs(spark, texts), "").collect()
    for d, t in enumerate(texts):
        assert ids_of(rows, d) == reference.encode(t, add_special_tokens=False).ids + [0], t
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.doc_tokens for r in queries.op3_packing(spark, str(tmp_path)).collect()}
    assert got == {d: len(reference.encode(t, add_special_tokens=False).ids) + 1 for d, t in enumerate(texts)}


def test_packing_of_long_white_space(spark):
    n = 1_200_000
    texts = ["a" + " " * n + "b" + "\n" * n, "　" * n + " <|endoftext|>" + " " * n + "<|endoftext|>x", "x" + "\x85 " * (n // 2) + "'s", "x" + " \n" * (n // 2) + "\n1", "short"]
    reference = contract_tokenizer()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs(spark, texts).repartition(1), "").collect()
    for d, t in enumerate(texts):
        assert ids_of(rows, d) == reference.encode(t, add_special_tokens=False).ids + [0], d


LONG = "Some running text that goes on for a good while, and then more of it. " * 6


def test_main_text_of_div_only_pages():
    menu = "<div><ul><li><a href=a>Home page</a><li><a href=b>All about us</a></ul></div>"
    parts = f"<div><p>{LONG}</p></div><div><h2>Section</h2><p>Short para.</p></div>"
    expected = f"{LONG}Section Short para."
    assert main_text.main_text(f"<body><div class=post-body>{parts}</div></body>") == expected
    assert main_text.main_text(f"<body>{parts}</body>") == expected
    assert main_text.main_text(f"<body><div id=page><div><div>{parts}</div></div>{menu}<div class=footer>Me</div></div>") == expected
    assert main_text.main_text(f"<body><div><p>{LONG}</p></div><div>Between.</div><div><p>{LONG}</p></div>") == f"{LONG}Between. {LONG.strip()}"
    assert main_text.main_text(f"<section>{parts}</section><section>{menu}</section>") == expected


def test_main_text_of_marked_wrappers():
    article = f"<article><h1 class=page-header>Title</h1><p>{LONG}</p><div class=comments><p>{LONG}</p></div></article>"
    for wrapper in ("has-sidebar", "wrap sidebar-left", "withSidebar"):
        assert main_text.main_text(f"<body><nav><a>x</a></nav><div class='{wrapper}'>{article}</div>") == f"Title {LONG.strip()}", wrapper
    assert main_text.main_text(f"<div class=no-sidebar><div><p>{LONG}</p></div></div>") == LONG.strip()
    teaser = "<div class=related><article><p>Read this teaser, too.</p></article></div>"
    assert main_text.main_text(f"<body><div><p>{LONG}</p></div>{teaser}") == LONG.strip()
    assert main_text.main_text(f"<aside><article><p>{LONG}</p></article></aside>") == ""


def test_wrapped_licenses(spark):
    import textwrap

    s = licenses.SENTENCES
    bsd = ["bsd-grant", "bsd-source", "bsd-binary"]
    whole = {
        "MIT": f"MIT License\nCopyright (c) 2020 Me\n{s['mit-grant']}\n\n{s['mit-condition']}",
        "GPL-3.0-or-later": f"{s['gpl-grant']}\n\n{s['gpl-warranty']}",
        "GPL-2.0-or-later": f"This program is free software; {s['gpl2-grant']}\n\n{s['gpl-warranty']}",
        "LGPL-2.1-or-later": f"This library is free software; {s['lgpl21-grant']}",
        "AGPL-3.0-or-later": f"This program is free software: {s['agpl3-grant']}\n\n{s['gpl-warranty']}",
        "BSD-2-Clause": "\n".join(s[k] for k in bsd) + "\n\nTHIS SOFTWARE IS PROVIDED",
        "BSD-3-Clause": "\n\n".join(f"{i}. {s[k]}" for i, k in enumerate([*bsd, "bsd-names"])),
        "ISC": s["isc-grant"], "MPL-2.0": s["mpl2-notice"], "CC0-1.0": s["cc0-dedication"],
        "Apache-2.0": f"{s['apache-grant']}\n{s['apache-condition']}",
    }
    texts, expected = [], []
    for name, text in whole.items():
        for width, mark, end in ((200, "", "\n"), (70, "", "\n"), (42, "# ", "\n"), (25, " * ", "\r\n"), (60, ";; ", "\n"), (8, "// ", "\n")):
            lines = [x for line in text.split("\n") for x in textwrap.wrap(line, width, break_long_words=False) or [""]]
            texts.append("int x" + end + end.join(mark + x for x in lines) + end + "int y")
            expected.append([name])
    texts += ["this\n" * 2000, "permission is\n" * 2000 + "hereby", s["mit-condition"].replace(" ", "\n") + "\n" + s["mit-grant"].replace(" ", "\n")]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[d] for d in range(len(texts))] == [*expected, [], [], []]


def chat_by_force(rows, part_turns):
    dialogues, views = {}, {}
    for conv, turn, role, text in set(rows):
        dialogues.setdefault(conv, set()).add((turn is not None, turn or 0, role or "", text or ""))
    for conv, messages in dialogues.items():
        messages = sorted(messages)
        for speaker in {m[2] for m in messages} - {"system"}:
            for at in range(0, len(messages), part_turns):
                text, n_own, masks = "", 0, []
                shown = [m for m in messages[:at] if m[2] == "system"] + messages[at : at + part_turns]
                for _, _, role, said in shown:
                    text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f'<|user name="{role}"|>\n'
                    if role == speaker:
                        masks.append((len(text), len(text) + len(said) + len("<|end|>\n")))
                    text += said + "<|end|>\n"
                views[conv, at // part_turns, speaker] = (text, len(shown), len(masks), masks)
    return views


def test_chat_of_long_dialogues(spark):
    rows = [(1, i, ["ann", "bob"][i % 2], f"é{i}") for i in range(1, 1300)] + [(1, 0, "system", "be kind"), (1, 600, "system", "be brief"), (1, 3, "cid", "hm")]
    rows += [(2, None, "ann", f"x{i}") for i in range(700)] + [(None, 7, ["ann", None][i % 2], f"y{i}") for i in range(1100)] + [(3, 9000, "system", "s"), (3, 9001, "ann", "t")]
    rows += [(4, i, "system", "s") for i in range(600)] + [(5, 1, "ann", "same")] * 600
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    for part_turns in (chat.PART_TURNS, 100):
        got = {(r.conv_id, r.part, r.speaker): (r.text, r.n_turns, r.n_own, [tuple(m) for m in r.masks]) for r in chat.rotate(frame, part_turns).collect()}
        assert got == chat_by_force(rows, part_turns)
        assert max(n for _, n, _, _ in got.values()) <= part_turns + 2


def test_secrets_of_one_owner_stay_live(spark):
    frame = docs(spark, ["password: Abcdefgh12345678"] * 40).withColumn("source", F.lit(None).cast("string"))
    found = secrets.verdicts(secrets.candidates(frame, ["doc_id"])).select("n_owners", "n_repositories", "live").distinct().collect()
    assert [tuple(r) for r in found] == [(1, 40, True)]
    assert {r.text for r in secrets.redact(frame).collect()} == {"[SECRET]"}
