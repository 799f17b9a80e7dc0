"""Inputs that an operator once cut before its tests saw them."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from plumbline.llm import op3_token_files as op3
from plumbline.llm import op9_secrets as op9
from tests.llm.helpers import documents, new_folder


def test_token_files_give_the_librarys_ids_for_added_tokens(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a \n <|endoftext|>  b", "plain words", "<|endoftext |> no"]
    tok, want, start = Tokenizer.from_file(path), {}, 0
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[i], start = (start, len(ids), zlib.crc32(ids.tobytes())), start + len(ids)
    folder = new_folder(tmp_path)
    manifest = op3.write_token_files(documents(spark, list(enumerate(texts))), folder, path)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op3.read_token_files(manifest, folder).collect()} == want


def test_random_strings_after_equals_short_and_without_digits_are_found(spark):
    rng = random.Random(21)
    letters = op9.ALPHABETS["base64"][:62]
    words = ["the", "house", "of", "parliament", "and", "garden", "water", "under", "light", "paper"]
    plain = ["INTERNATIONALIZATION", "getParliamentGardenPaper", "max_paper_under_water_light", "COUNTERREVOLUTIONARY", "parliament-under-the-garden"]
    forms = ["AWS_KEY={}", "https://x.org/a?sig={}&n=1", "run --key={}", "access_key={}", "key: {}", "sig={}=="]
    keys = {}
    for i in range(0, 600, 10):
        alphabet, n = ((letters, 44), (letters, 16), (letters[:52], 20))[i // 10 % 3]
        keys[i] = (forms[i // 30 % 6], "".join(rng.choices(alphabet, k=n)))
    rows = [(i, " ".join(rng.choices(words, k=60)) + " " + (keys[i][0].format(keys[i][1]) if i in keys else plain[i % 5]) + " " + " ".join(rng.choices(words, k=5))) for i in range(600)]
    assert all(any(k[1] == c["token"] for c in op9.candidates(rows[i][1], [])) for i, k in keys.items())
    found = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["spans"]] for r in op9.find_secrets(documents(spark, rows)).collect()}
    assert sum(any(s.rstrip("=") == keys[i][1] for s in found[i]) for i in keys) >= 0.9 * len(keys)
    assert all(not found[i] for i in range(600) if i not in keys)
    padded = next(i for i in keys if keys[i][0] == "sig={}==" and found[i])
    assert found[padded][0].endswith("==")
