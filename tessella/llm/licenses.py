"""License scans: templates with optional and replaceable regions, compiled to token automata.

A template is written as license lists write theirs: `<<beginOptional>> ... <<endOptional>>` may be
left out, `<<var;min=a;max=b>>` stands for a to b words of any kind, everything else is wording that
has to stand there word for word. `compile_template` makes a nondeterministic automaton over words;
`scan` accepts the places where it runs from its first state to an accepting one.

Null and empty texts have no words, no places and score 0. Very long texts are read whole: an
automaton only starts where its first word stands, and only in a text that has the longest run of
words its template demands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tessella.llm.common import text_bytes

#: Phrases with their labels, by the contract of the query.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: What a holder, a year or a name may be.
_HOLDER = "<<var;min=1;max=12>>"
_AS_IS = (
    "this software is provided by " + _HOLDER + " as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall " + _HOLDER + " be liable for any direct indirect incidental special exemplary or "
    "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on "
    "any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of "
    "the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution "
)

#: Public license wording in template markup, whole texts and the notices that stand for them.
TEMPLATES = {
    "mit-text": (
        "<<beginOptional>><<beginOptional>>the<<endOptional>> mit license <<beginOptional>>mit<<endOptional>><<endOptional>> "
        "<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=20>><<endOptional>> "
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall " + _HOLDER + " be liable for any claim damages or other liability whether "
        "in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "isc-text": (
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and " + _HOLDER + " disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall " + _HOLDER + " be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from "
        "loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-text": _BSD + _AS_IS,
    "bsd-3-text": _BSD + (
        "<<beginOptional>>3<<endOptional>> neither the name of " + _HOLDER + " nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission "
    ) + _AS_IS,
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "<<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
        "acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not "
        "be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution"
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
        "as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "apache-2-header": (
        "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> you may not use <<var;min=1;max=4>> except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-header": (
        "<<var;min=1;max=4>> is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> "
        "general public license as published by the free software foundation either version <<var;min=1;max=2>> of the license or <<beginOptional>>at your option<<endOptional>> any later version"
    ),
    "mit-grant": "<<beginOptional>>released<<endOptional>> under the mit license <<beginOptional>>see the license file <<beginOptional>>for details<<endOptional>> <<endOptional>>",
    "apache-2-notice": "<<beginOptional>>licensed<<endOptional>> under the apache license version 2 <<beginOptional>>0<<endOptional>>",
    "cc-by-nc-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> <<var;min=1;max=1>> 0",
    "gpl-notice": (
        "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license "
        "<<beginOptional>>version<<endOptional>> <<var;min=1;max=1>>"
    ),
    "spdx-tag": "spdx license identifier <<var;min=1;max=1>>",
    "all-rights-reserved": "<<beginOptional>>copyright <<var;min=1;max=12>><<endOptional>> all rights reserved",
}

#: Bytes that part words become spaces, A-Z become a-z, all others stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Automaton:
    """Words lead from state to state; `free` has the moves without a word; `any_word` the moves by any word."""

    moves: list[dict[bytes, int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    any_word: list[int | None] = field(default_factory=list)
    accept: int = 0
    demanded: bytes = b""

    def state(self) -> int:
        self.moves.append({})
        self.free.append([])
        self.any_word.append(None)
        return len(self.moves) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            new = [x for x in self.free[todo.pop()] if x not in seen]
            seen.update(new)
            todo += new
        return frozenset(seen)

    def __post_init__(self) -> None:
        self.steps: dict[tuple[frozenset[int], bytes | None], frozenset[int]] = {}

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        known = word if any(word in self.moves[s] for s in states) else None
        got = self.steps.get((states, known))
        if got is None:
            got = self.closed({x for s in states for x in (self.moves[s].get(word), self.any_word[s]) if x is not None})
            self.steps[states, known] = got
        return got

    def match(self, words: list[bytes], at: int) -> int | None:
        """Where the longest accepted run of words from `at` ends."""
        states, end = self.start, None
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.accept in states:
                end = i + 1
        return end


def compile_template(template: str) -> Automaton:
    """The automaton of a template. Regions nest; an unbalanced mark or a template that accepts no word is an error."""
    a = Automaton()
    at = a.state()
    opened: list[int] = []
    runs: list[list[bytes]] = [[]]
    for part in re.findall(r"<<[^>]*>>|[^<]+", template):
        mark = part.strip("<>").split(";") if part.startswith("<<") else None
        if mark is None:
            for word in part.encode().translate(FOLD).split():
                new = a.state()
                a.moves[at][word] = new
                at = new
                if not opened:
                    runs[-1].append(word)
        elif mark[0] == "beginOptional":
            new = a.state()  # a state of its own, so that leaving the region can't enter it again
            a.free[at].append(new)
            at = new
            opened.append(at)
            runs.append([])
        elif mark[0] == "endOptional":
            if not opened:
                raise ValueError(f"no region to end: {template}")
            new = a.state()
            a.free[at].append(new)
            a.free[opened.pop()].append(new)
            at = new
        elif mark[0] == "var":
            bounds = dict(x.split("=") for x in mark[1:] if "=" in x)
            least, most = int(bounds.get("min", 0)), int(bounds.get("max", 10))
            skips = []
            for k in range(most):
                if k >= least:
                    skips.append(at)
                new = a.state()
                a.any_word[at] = new
                at = new
            for x in skips:
                a.free[x].append(at)
            runs.append([])
        else:
            raise ValueError(f"unknown mark {part}")
    if opened:
        raise ValueError(f"a region doesn't end: {template}")
    a.accept = at
    a.start = a.closed({0})
    if a.accept in a.start:
        raise ValueError(f"it accepts no words at all: {template}")
    a.demanded = b" " + b" ".join(max(runs, key=len)) + b" "
    return a


def folded(raw: bytes) -> list[bytes]:
    """Words of one text: A-Z lower-cased, parted at every ASCII byte that is no letter or digit."""
    return raw.translate(FOLD).split()


def scan_one(raw: bytes, phrases: dict[bytes, str], automata: dict[str, Automaton]) -> dict:
    """Places of the phrases and labels of the accepted templates in one text."""
    words = folded(raw)
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in phrases.items():
        find, at = b" " + phrase + b" ", 0
        while (at := line.find(find, at)) >= 0:
            starts.append(at)
            base.add(label)
            at += 1
    spans = []
    for label, a in automata.items():
        if a.demanded in line:
            first = {w for s in a.start for w in a.moves[s]}
            wild = any(a.any_word[s] is not None for s in a.start)
            past = 0  # places inside an accepted one are not looked at again
            for i, w in enumerate(words):
                if i >= past and (wild or w in first) and (end := a.match(words, i)) is not None:
                    spans.append((label, i, end))
                    past = end
    labels = base | {x for x, _, _ in spans}
    return {
        "n_words": len(words), "n_base": len(starts),
        "first_word": line.count(b" ", 0, min(starts)) if starts else None, "last_word": line.count(b" ", 0, max(starts)) if starts else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 if spans else 0.5 if base else 0.0,
        "spans": [{"label": x, "first": i, "end": j} for x, i, j in sorted(spans)],
    }


_FOUND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))])


def scanner(phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None):
    """A column function: text to struct of word count, phrase places, labels, score and accepted spans.

    score: 1 if a template accepts a place, 0.5 if only phrases stand in the text, else 0.
    """
    told = {p.encode(): label for p, label in (PHRASES if phrases is None else phrases).items()}
    automata = {label: compile_template(t) for label, t in (TEMPLATES if templates is None else templates).items()}

    @F.arrow_udf(from_arrow_type(_FOUND))
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([scan_one(raw, told, automata) for raw in text_bytes(texts)], _FOUND)

    return scan
