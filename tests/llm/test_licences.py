"""The licence classifier on wordings that it was not fitted on, and its scores against plain Python."""

import math
import re

import pytest

from lectern.llm import licences
from lectern.session import read_table

HELD_OUT = [
    ("apache-2.0", "This module is Apache 2.0 software."), ("apache-2.0", "Code in this folder: Apache-2.0 licensed, see NOTICE."),
    ("apache-2.0", "The project uses the Apache License version 2.0 for all sources."), ("mit", "License: MIT (see COPYING)"),
    ("mit", "All of the code here is available under the MIT license."), ("mit", "Dual use is fine, the terms are those of the MIT License"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("bsd", "You can use it under the New BSD License."),
    ("bsd", "The names of the contributors may not be used to endorse or promote products derived from this software without prior written permission."),
    ("gpl", "Shipped under GPLv2 only."), ("gpl", "gpl v3 or any later version applies"), ("gpl", "Free software under the GNU GPL, see COPYING."),
    ("lgpl", "The library is under the LGPLv3."), ("lgpl", "Linked parts are covered by the GNU LGPL v2.1"), ("mpl", "Files here fall under the Mozilla Public License 2.0"),
    ("mpl", "MPL-2.0 applies to this file"), ("cc-by", "Photos are CC BY 3.0, credit the author."), ("cc-by-nc", "The text is shared as CC BY-NC-SA 4.0 by its author"),
    ("public-domain", "Dedicated to the public under CC0 1.0"), ("public-domain", "Released with CC0, no rights reserved"), ("isc", "The ISC license applies to all files."),
    ("epl", "Made available under the Eclipse Public License, version 1.0"), ("boost", "Use, modification and distribution are subject to the Boost Software License."),
    ("artistic", "You can use it under the same terms as Perl, that is the Artistic License."), ("zlib", "This is free under the zlib license"),
]
UNKNOWN = ["Licensed under the Vim licence agreement.", "Released under the Netscape community license.", "License: Ruby license agreement", "Distributed under the Open Data vendor license."]
PLAIN = ["She lost her driving license in the river.", "The museum granted permission to copy the map.", "Apache tribes and boost engines are not software.", "An eclipse is seen in the south.",
         "The public library opens at nine.", "mit dem hund in den garten", "The artistic skating team won."]


@pytest.fixture(scope="module")
def model(spark):
    return licences.LicenceModel.fit(read_table(spark, "/root/testdata/sf0.01", "documents"))


def test_no_held_out_sentence_is_a_phrase():
    own = {" ".join(t) for ts in licences.phrases().values() for t in ts}
    assert not own & {" ".join(licences._plain_words(t)) for _, t in HELD_OUT}


def test_recall_on_other_wordings(spark, docs, model):
    rows = [(i, t) for i, (_, t) in enumerate(HELD_OUT)] + [(100 + i, t) for i, t in enumerate(UNKNOWN)] + [(200 + i, t) for i, t in enumerate(PLAIN)]
    got = {r.doc_id: [f.family for f in r.found] for r in licences.scan_paragraphs(docs(rows), model).collect()}
    right = [f in got[i] for i, (f, _) in enumerate(HELD_OUT)]
    assert sum(right) >= 0.9 * len(right), [HELD_OUT[i] + (got[i],) for i, ok in enumerate(right) if not ok]
    wrong = [i for i, (f, _) in enumerate(HELD_OUT) if set(got[i]) - {f, licences.UNKNOWN}]
    assert len(wrong) <= 1
    named = [x for i in range(len(UNKNOWN)) for x in got[100 + i]]
    assert set(named) <= {licences.UNKNOWN} and len(named) >= 2
    assert not any(got[200 + i] for i in range(len(PLAIN)))


def test_scores_by_hand(spark, docs, model):
    """Softmax of the weights of the paragraph's distinct n-grams, in plain Python."""
    texts = [t for _, t in HELD_OUT] + UNKNOWN + [t for ts in licences.TEMPLATES.values() for t in ts[:2]]
    got = {r.doc_id: r.found for r in licences.scan_paragraphs(docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
        grams = {" ".join(words[j:j + n]) for n in (1, 2, 3) for j in range(len(words) - n + 1)}
        z = list(model.bias)
        for g in grams & set(model.features):
            z = [a + b for a, b in zip(z, model.features[g])]
        e = [math.exp(v - max(z)) for v in z]
        p = [v / sum(e) for v in e]
        if p[0] >= 0.5:
            assert got[i] == []
            continue
        scores = dict(zip(model.classes, p))
        for f in got[i]:
            assert math.isclose(f.score, max(scores[c] for c in model.classes[1:-1]) if f.family == licences.UNKNOWN else scores[f.family], rel_tol=1e-9)
            assert f.confirmed or (f.family == licences.UNKNOWN) == (max(scores[c] for c in model.classes[1:-1]) < model.threshold)


def test_fit_on_nothing_still_scans(spark, docs):
    empty = licences.LicenceModel.fit(docs([]))
    got = licences.scan(docs([(1, "Released under the MIT License."), (2, "plain words"), (3, None)]), empty)
    assert {r.doc_id: r.licences for r in got.collect()} == {1: "mit", 2: "", 3: ""}
