"""Licence scan: sentences become identifiers, sequences of identifiers become licences.

A text is split at sentence ends, blank lines and line ends. A known licence sentence may
run over several lines, as in hard-wrapped notices: at each place the known sentences are
tried over as many lines as they take, and only where none fits the line stands alone.
What is no known sentence but mentions a licence word is ``unknown``. A document's
identifiers, in order, form a sequence, and an ordered list of rules is matched
against it from left to right: at each place the first rule that fits takes its
sentences, and passes over the filler of the notices (disclaimers, where to find the
text). Everything is an expression on one row; texts without a licence word cost
one pattern search.

Defined cases: a null or empty text has no sentences. Repeated rows are scanned alike.
The SQL of the query knows only ``WORDS``, ``BREAKS``, ``SENTENCES`` and ``RULES``: sentences
on one line with one of those words. It misses wrapped notices, their filler, and Creative
Commons, CC0 and ISC sentences without such a word; the given tables hold none of these.
Other columns pass unchanged; columns named ``sentences``, ``licences`` or ``n_unknown``
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.fence import fenced

#: Words of a licence sentence in the SQL, which knows no others.
WORDS = "licen[cs]e|copyright|warranty|permission is hereby|redistribution|spdx|public domain"
#: Words of a licence sentence, normalised: every sentence that has a name holds one of them.
ASKED = WORDS + "|permission to use copy|cc by (?:nc|nd|sa|[0-9])|creative commons|cc0 1 0|\\bcc0\\b"
#: The same in a text as it stands, where other characters may lie between two words.
GATE = "(?=[clprsw])(?:" + ASKED.replace(" ", "[^\\p{L}\\p{N}]+") + ")"
BREAKS = "[\\n]+|[.!?;]+[ \\t\\r]+"
_LEAD = "(?:this (?:work|program|software|file|project|code|library) is |the (?:code|software|project) is )?"
_UNDER = f"{_LEAD}(?:licensed|released|distributed|available|made available) under (?:the )?(?:terms of (?:the )?)?"
#: Identifier, and the pattern of the whole normalised sentence; the first that fits names it.
SENTENCES = (
    ("spdx_apache2", "spdx license identifier apache 2 0"),
    ("spdx_mit", "spdx license identifier mit"),
    ("spdx_gpl3", "spdx license identifier gpl 3 0(?: only| or later)?"),
    ("spdx_gpl2", "spdx license identifier gpl 2 0(?: only| or later)?"),
    ("spdx_bsd3", "spdx license identifier bsd 3 clause"),
    ("apache2_use", _UNDER + "apache (?:software )?license (?:version )?2(?: 0)?"),
    ("apache2_comply", "you may not use this file except in compliance with the license"),
    ("mit_use", _UNDER + "(?:mit|expat) licen[cs]e"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("mit_warranty", "the software is provided as is without warranty of any kind.*"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose.*"),
    ("bsd3_use", _UNDER + "(?:3 clause|new|modified) bsd licen[cs]e"),
    ("bsd2_use", _UNDER + "(?:2 clause|simplified) bsd licen[cs]e"),
    ("bsd_grant", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("lgpl_use", _UNDER + "gnu lesser general public licen[cs]e(?: version)? (?:2 1|3)(?: 0)?"),
    ("agpl3_use", _UNDER + "gnu affero general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("gpl3_use", _UNDER + "gnu general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("gpl2_use", _UNDER + "gnu general public licen[cs]e(?: version)? 2(?: 0)?"),
    ("gpl_later", "either version [23] of the license or at your option any later version"),
    ("mpl2_use", _UNDER + "mozilla public licen[cs]e (?:version )?2 0"),
    ("ccbync4_use", _UNDER + "(?:cc by nc|creative commons attribution noncommercial)(?: licen[cs]e)? 4 0"),
    ("ccbysa4_use", _UNDER + "(?:cc by sa|creative commons attribution sharealike)(?: licen[cs]e)? 4 0"),
    ("ccby4_use", _UNDER + "(?:cc by|creative commons attribution)(?: licen[cs]e)? 4 0"),
    ("cc0_use", ".*(?:cc0 1 0|released into the public domain|dedicated to the public domain).*"),
    ("all_rights", "copyright.* all rights reserved"),
    ("notice", "copyright (?:c )?(?:[0-9]{4}|\\W).*"),
)
_FREE = "(?:.* is free software )?you (?:can|may) redistribute it and or modify (?:it )?under the terms of the "
_FSF = "as published by the free software foundation"
_LATER = "(?: of the license)? or at your option any later version"
_GNU = "gnu (?:lesser |library |affero )?general public license"
_NO = "(?:[0-9a-d] )?"
_PRIOR = "endorse or promote products derived from this software without (?:specific )?prior written permission"


def _gnu(name: str, version: str) -> str:
    """A licence of the Free Software Foundation, in one version only."""
    return _FREE + f"{name} (?:version {version}(?: only)? {_FSF}|{_FSF} version {version}(?: of the license)?(?: only)?)"


#: The sentences of the usual notices, which go first. ``~`` is any text within one sentence.
NOTICES = (
    ("apache2_use", _UNDER + "apache license version 2 0 the license"),
    ("apache2_use", "(?:.* )?licenses this file to you under the apache license version 2 0 the license"),
    ("asf_grant", "licensed to ~ under one or more contributor license agreements"),
    ("asf_notice", "see the notice file distributed with this work for (?:additional )?information regarding copyright ownership"),
    ("apache2_obtain", "you may obtain a copy of the license at(?: https? www apache org licenses license 2 0(?: txt| html)?)?"),
    ("apache2_url", "https? www apache org licenses license 2 0(?: txt| html)?"),
    ("apache2_basis", "unless required by applicable law or agreed to in writing software distributed under the license is "
     "distributed on an as is basis without warranties or conditions of any kind(?: either express or implied)?"),
    ("apache2_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights to use "
     "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
     "software is furnished to do so subject to the following conditions"),
    ("mit_keep", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all "
     "copies or substantial portions of the software"),
    ("mit_warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to "
     "the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("mit_liable", "in no event shall ~ be liable for any claim damages or other liability whether in an action of contract tort "
     "or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc_grant", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd_grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("bsd_source", _NO + "redistributions? of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer"),
    ("bsd_binary", _NO + "redistributions? in binary form must reproduce the above copyright notice this list of conditions and the "
     "following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_advert", _NO + "all advertising materials mentioning features or use of this software must display the following "
     "acknowledge?ments?(?: this product includes software developed by .*)?"),
    # An organisation's "Inc." ends a sentence.
    ("bsd_endorse", f"(?:{_NO}neither the names? of ~ )?nor the names of ~ may be used to {_PRIOR}"),
    ("bsd_endorse", f"{_NO}the names? of ~ may not be used to {_PRIOR}"),
    ("bsd_endorse", ".*endorse or promote products.*"),
    ("bsd_warranty", "this software is provided by ~ as is and any express or implied warranties including but not limited to the "
     "implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd_liable", "in no event shall ~ be liable for any direct indirect incidental special exemplary or consequential damages "
     "including but not limited to procurement of substitute goods or services loss of use data or profits or business "
     "interruption however caused and on any theory of liability whether in contract strict liability or tort including "
     "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("gpl3_notice", _FREE + f"gnu general public license {_FSF} either version 3{_LATER}"),
    ("gpl2_notice", _FREE + f"gnu general public license {_FSF} either version 2{_LATER}"),
    ("lgpl_notice", _FREE + f"gnu (?:lesser|library) general public license {_FSF} either version [0-9](?: [0-9])?{_LATER}"),
    ("agpl3_notice", _FREE + f"gnu affero general public license {_FSF} either version 3{_LATER}"),
    ("gpl3_only", _gnu("gnu general public license", "3")),
    ("gpl2_only", _gnu("gnu general public license", "2")),
    ("lgpl_only", _gnu("gnu (?:lesser|library) general public license", "[0-9](?: [0-9])?")),
    ("agpl3_only", _gnu("gnu affero general public license", "3")),
    ("gpl_warranty", "(?:.* is )?distributed in the hope that it will be useful but without any warranty without even the implied "
     "warranty of merchantability or fitness for a particular purpose"),
    ("gpl_details", f"see the {_GNU} for more details"),
    ("gpl_copy", f"you should have received a copy of the {_GNU} along with (?:this|the) [a-z]+(?: if not (?:see|write to) .*)?"),
    ("gpl_see", "if not see https? www gnu org licenses.*"),
)
#: Licence, and the identifiers that stand for it in a row; earlier rules go first.
RULES = (
    ("MIT", ("mit_grant", "mit_warranty")),
    ("GPL-3.0-or-later", ("gpl3_use", "gpl_later")),
    ("GPL-2.0-or-later", ("gpl2_use", "gpl_later")),
    ("Apache-2.0", ("apache2_use", "apache2_comply")),
    ("Apache-2.0", ("apache2_use",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("MIT", ("mit_use",)),
    ("MIT", ("mit_grant",)),
    ("MIT", ("spdx_mit",)),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", ("bsd3_use",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("BSD-2-Clause", ("bsd2_use",)),
    ("BSD", ("bsd_grant",)),
    ("LGPL", ("lgpl_use",)),
    ("AGPL-3.0", ("agpl3_use",)),
    ("GPL-3.0", ("gpl3_use",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("GPL-2.0", ("gpl2_use",)),
    ("GPL-2.0", ("spdx_gpl2",)),
    ("MPL-2.0", ("mpl2_use",)),
    ("CC-BY-NC-4.0", ("ccbync4_use",)),
    ("CC-BY-SA-4.0", ("ccbysa4_use",)),
    ("CC-BY-4.0", ("ccby4_use",)),
    ("CC0-1.0", ("cc0_use",)),
    ("All-Rights-Reserved", ("all_rights",)),
)
#: Rules over the sentences of the usual notices, which go first.
NOTICE_RULES = (
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse", "bsd_warranty")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    # Only the disclaimer behind it tells that no further condition follows.
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty")),
    ("Apache-2.0", ("asf_grant", "asf_notice", "apache2_use", "apache2_comply")),
    ("GPL-3.0-or-later", ("gpl3_notice",)),
    ("GPL-2.0-or-later", ("gpl2_notice",)),
    ("LGPL", ("lgpl_notice",)),
    ("LGPL", ("lgpl_only",)),
    ("AGPL-3.0-or-later", ("agpl3_notice",)),
    ("AGPL-3.0", ("agpl3_only",)),
    ("GPL-3.0", ("gpl3_only",)),
    ("GPL-2.0", ("gpl2_only",)),
)
#: Known sentences that name no licence; a rule takes those between and behind its own.
FILLER = (
    "apache2_obtain", "apache2_url", "apache2_basis", "apache2_see", "mit_keep", "mit_liable", "bsd_liable", "gpl_warranty",
    "gpl_details", "gpl_copy", "gpl_see",
)
MADE = ("sentences", "licences", "n_unknown")


def identifier(sentence: Column) -> Column:
    """The known sentence that a normalised sentence is, or ``unknown``."""
    known = F.when(F.lit(False), F.lit(""))
    for name, pattern in NOTICES + SENTENCES:
        known = known.when(sentence.rlike(f"^(?:{pattern.replace('~', '.+?')})$"), name)
    return known.otherwise("unknown")


#: Between fragments of a text: a line end, the end of a sentence or paragraph, a semicolon.
_LINE, _END, _SEMI = "\n", "\u0002", "\u0003"
_MARKS = _LINE + _END + _SEMI


def marked(text: Column) -> Column:
    """Lower case and normalised, with marks between the fragments."""
    s = F.translate(F.lower(text), _END + _SEMI, "  ")
    for pattern, put in (
        ("(?<![.!?;]);++(?=[ \\t\\r\\n]|\\z)", _SEMI),
        ("(?<![.!?;])[.!?;]++(?=[ \\t\\r\\n]|\\z)", _END),
        (f"[^\\p{{L}}\\p{{N}}{_MARKS}]+", " "),
        (f"(?<![ {_LINE}{_SEMI}])[ {_LINE}{_SEMI}]*(?:{_END}|{_LINE} *{_LINE})[ {_MARKS}]*", _END),
        (f"(?<![ {_LINE}])[ {_LINE}]*{_SEMI}[ {_LINE}{_SEMI}]*", _SEMI),
        (f" *{_LINE} *", _LINE),
    ):
        s = F.regexp_replace(s, pattern, put)
    return F.btrim(s, F.lit(" " + _MARKS))


def _over_lines(pattern: str, gap: str) -> str:
    """A pattern that takes a mark of ``gap`` for a space; what it leaves open stays on one line."""
    rest = pattern.replace("\\W", "[^\\w\0]").replace(" ", f"[ {gap}]").replace(".*", "[^\0]*")
    return rest.replace("~", f"[^{_END}]+?").replace("\0", _MARKS)


def sentences_of(text: Column) -> Column:
    """Known sentences, over as many lines as they take, and the fragments between them; normalised."""
    known = [_over_lines(p, _LINE + _SEMI) for _, p in NOTICES] + [_over_lines(p, _LINE) for _, p in SENTENCES]
    # A notice may go over semicolons, the other sentences end there.
    one = f"(?<![^{_MARKS}])({'|'.join(known)}|[^{_MARKS}]+)(?![^{_MARKS}])"
    return F.transform(F.regexp_extract_all(marked(text), F.lit(one), F.lit(1)), lambda s: F.translate(s, _LINE + _SEMI, "  "))


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentences`` (identifiers in order), ``licences`` (those found, in
    order, each once) and ``n_unknown`` (licence sentences that no rule took)."""
    own = [c for c in docs.columns if c not in MADE]
    body = F.col(text)
    named = F.transform(sentences_of(body), lambda s: F.struct(identifier(s).alias("name"), s.rlike(ASKED).alias("asked")))
    found = F.transform(F.filter(named, lambda s: s["asked"] | (s["name"] != "unknown")), lambda s: s["name"])
    none = F.array().cast("array<string>")
    df = docs.select(*own).withColumn("sentences", F.when(F.lower(body).rlike(GATE), found).otherwise(none))
    df = fenced(df, "sentences")
    # `<a><b>`: rules are tried in order at each place, as alternatives of one pattern.
    row = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    filler = f"(?:{'|'.join(f'<{s}>' for s in FILLER)})*+"
    rules = "|".join("".join(f"<{s}>{filler}" for s in ids) for _, ids in NOTICE_RULES + RULES)
    taken = F.transform(F.regexp_extract_all(row, F.lit(f"({rules})"), F.lit(1)), lambda t: F.regexp_replace(t, filler, ""))
    ways = reversed(NOTICE_RULES + RULES)
    names = F.create_map(*[F.lit(x) for name, ids in ways for x in ("".join(f"<{s}>" for s in ids), name)])
    rest = F.regexp_replace(row, rules, "")
    return df.select(
        *own,
        "sentences",
        F.array_distinct(F.transform(taken, lambda t: names[t])).alias("licences"),
        (F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit("")))).cast("long").alias("n_unknown"),
    )
