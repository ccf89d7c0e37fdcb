"""License scans: ordered signature rules behind a keyword prefilter.

``SIGNATURES`` are hand-written regexes, each with a label, a priority, a confidence and the keyword without
which it can't match: SPDX tags and addresses, sentences of license texts, names with versions, short names.
A rule runs only where one of its keywords occurs in the text with all gaps folded. Detections are taken by
priority, then by length; one whose words lie inside a taken detection, or overlap one of higher priority,
goes. The four base phrases are always reported, whatever suppresses them as detections.

Words are runs of digits, a-z (A-Z lower-cased) and all bytes beyond ASCII; a blank in a rule stands
for any run of other characters. Defined results: a null or empty text has no words, no labels and a
score of 0. Empty tables give empty results; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SYMBOL, Words, prepare, read_table, spans, strings

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Hand-written signatures: label | priority | confidence | keywords, one of which must occur | pattern.
#: In a pattern a blank is any gap between words; V is an optional version number.
SIGNATURES = r"""
agpl | 90 | 0.99 | agpl | spdx licen[sc]e identifier agpl 3 0(?: only| or later)?
agpl | 90 | 0.99 | affero | licensed under(?: the)?(?: terms of)?(?: the)? gnu affero general public licen[sc]e V
agpl | 85 | 0.97 | agpl | gnu org licenses agpl(?: 3 0)?
agpl | 70 | 0.95 | affero | gnu affero general public licen[sc]e V
agpl | 60 | 0.9 | affero | affero general public licen[sc]e V
agpl | 55 | 0.9 | affero | affero gpl V
agpl | 40 | 0.8 | agpl | agpl ?v?3(?: 0)?(?: only| or later)?
agpl | 30 | 0.7 | agpl | agpl
agpl | 80 | 0.9 | interact | users interacting with it remotely through a computer network
lgpl | 90 | 0.99 | lgpl | spdx licen[sc]e identifier lgpl 2 0(?: only| or later)?
lgpl | 90 | 0.99 | lgpl | spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?
lgpl | 90 | 0.99 | lgpl | spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?
lgpl | 85 | 0.97 | lesser | under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation
lgpl | 85 | 0.97 | library | under the terms of the gnu library general public licen[sc]e as published by the free software foundation
lgpl | 85 | 0.97 | lgpl | gnu org licenses(?: old licenses)? lgpl(?: [23] [01])?
lgpl | 72 | 0.95 | lesser | gnu lesser general public licen[sc]e V
lgpl | 72 | 0.95 | library | gnu library general public licen[sc]e V
lgpl | 62 | 0.9 | lesser | lesser general public licen[sc]e V
lgpl | 62 | 0.9 | library | library general public licen[sc]e V
lgpl | 55 | 0.85 | lesser | lesser gpl V
lgpl | 40 | 0.8 | lgpl | lgpl ?v?[23](?: [01])?(?: only| or later)?
lgpl | 30 | 0.7 | lgpl | lgpl
gpl | 90 | 0.99 | gpl | spdx licen[sc]e identifier gpl 1 0(?: only| or later)?
gpl | 90 | 0.99 | gpl | spdx licen[sc]e identifier gpl 2 0(?: only| or later)?
gpl | 90 | 0.99 | gpl | spdx licen[sc]e identifier gpl 3 0(?: only| or later)?
gpl-classpath | 91 | 0.99 | classpath | gpl 2 0 with classpath exception(?: 2 0)?
gpl-classpath | 65 | 0.9 | classpath | classpath exception
gpl-linking | 65 | 0.85 | linking | special linking exception
gpl-gcc | 66 | 0.9 | gcc | gcc runtime library exception
gpl | 86 | 0.98 | redistribute | redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation
gpl | 84 | 0.95 | warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e for more details
gpl | 84 | 0.95 | received | you should have received a copy of the gnu general public licen[sc]e
gpl | 83 | 0.95 | gpl | gnu org licenses(?: old licenses)? gpl(?: [23] 0)?
gpl | 83 | 0.95 | copyleft | gnu org copyleft gpl(?: html)?
gpl | 75 | 0.95 | gnu | licensed under(?: the)?(?: terms of)?(?: the)? gnu general public licen[sc]e V
gpl | 75 | 0.95 | gnu | released under(?: the)?(?: terms of)?(?: the)? gnu general public licen[sc]e V
gpl | 71 | 0.95 | gnu | gnu general public licen[sc]e V
gpl | 61 | 0.85 | general | general public licen[sc]e V
gpl | 56 | 0.85 | gnu | gnu gpl V
gpl | 50 | 0.85 | gpl | licensed under(?: the)? gpl V
gpl | 40 | 0.75 | gpl | gpl ?v?[123](?: 0)?(?: only| or later)?
gpl | 35 | 0.7 | gpl | gpl licen[sc]e
gpl | 30 | 0.6 | gpl | gpl
gpl | 88 | 0.95 | verbatim | everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document
gfdl | 90 | 0.99 | gfdl | spdx licen[sc]e identifier gfdl 1 [123](?: only| or later)?
gfdl | 85 | 0.97 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl | 72 | 0.95 | documentation | gnu free documentation licen[sc]e V
gfdl | 62 | 0.9 | documentation | free documentation licen[sc]e V
gfdl | 30 | 0.7 | gfdl | gfdl
apache | 90 | 0.99 | apache | spdx licen[sc]e identifier apache [12] [01]
apache | 88 | 0.99 | apache | licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
apache | 86 | 0.97 | apache | apache org licenses licen[sc]e 2 0(?: txt| html)?
apache | 84 | 0.9 | express | distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind either express or implied
apache | 75 | 0.95 | apache | licensed under(?: the)?(?: terms of)?(?: the)? apache(?: software)? licen[sc]e V
apache | 72 | 0.95 | apache | apache software licen[sc]e V
apache | 70 | 0.95 | apache | apache licen[sc]e V
apache | 45 | 0.8 | apache | apache ?v?2(?: 0)?(?: only| or later)?
apache | 35 | 0.6 | asl | asl 2 0
mit | 90 | 0.99 | mit | spdx licen[sc]e identifier mit
mit-0 | 91 | 0.99 | mit | spdx licen[sc]e identifier mit 0
mit | 88 | 0.98 | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 87 | 0.9 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 86 | 0.85 | noninfringement | as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 84 | 0.97 | mit | opensource org licenses mit(?: licen[sc]e)?(?: php)?
mit | 75 | 0.95 | mit | licensed under(?: the)?(?: terms of)?(?: the)? mit(?: licen[sc]e)?
mit | 75 | 0.95 | mit | released under(?: the)?(?: terms of)?(?: the)? mit(?: licen[sc]e)?
mit | 75 | 0.95 | mit | distributed under(?: the)?(?: terms of)?(?: the)? mit(?: licen[sc]e)?
mit-0 | 72 | 0.9 | mit | mit no attribution(?: licen[sc]e)?
mit | 70 | 0.95 | mit | mit licen[sc]e
mit | 65 | 0.9 | mit | mit style licen[sc]e
mit | 65 | 0.9 | expat | expat licen[sc]e
x11 | 65 | 0.85 | x11 | x11 licen[sc]e
bsd-2-clause | 90 | 0.99 | bsd | spdx licen[sc]e identifier bsd 2 clause(?: patent)?
bsd-3-clause | 90 | 0.99 | bsd | spdx licen[sc]e identifier bsd 3 clause(?: clear)?
bsd-4-clause | 90 | 0.99 | bsd | spdx licen[sc]e identifier bsd 4 clause
0bsd | 90 | 0.99 | 0bsd | spdx licen[sc]e identifier 0bsd
bsd | 87 | 0.9 | redistribution | redistribution and use in source and binary forms
bsd-3-clause | 88 | 0.9 | endorse | neither the name of .{1,80}? may be used to endorse or promote products derived from this software
bsd-4-clause | 88 | 0.9 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 84 | 0.85 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 84 | 0.85 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | 72 | 0.95 | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | 72 | 0.95 | bsd | bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2-clause | 72 | 0.95 | freebsd | freebsd licen[sc]e
bsd-2-clause | 72 | 0.95 | simplified | simplified bsd(?: licen[sc]e)?
bsd-3-clause | 72 | 0.95 | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | 72 | 0.95 | bsd | bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause | 72 | 0.95 | bsd | (?:new|modified|revised) bsd(?: licen[sc]e)?
bsd-4-clause | 72 | 0.95 | bsd | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause | 72 | 0.95 | bsd | bsd (?:4|four) clause(?: licen[sc]e)?
bsd-4-clause | 72 | 0.9 | bsd | original bsd(?: licen[sc]e)?
0bsd | 73 | 0.95 | bsd | zero clause bsd(?: licen[sc]e)?
0bsd | 73 | 0.95 | bsd | bsd zero clause(?: licen[sc]e)?
bsd | 75 | 0.95 | bsd | licensed under(?: the)?(?: terms of)?(?: the)? bsd(?: style)? licen[sc]e
bsd | 70 | 0.9 | bsd | bsd licen[sc]e
bsd | 65 | 0.85 | bsd | bsd style(?: licen[sc]e)?
isc | 90 | 0.99 | isc | spdx licen[sc]e identifier isc
isc | 88 | 0.95 | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 70 | 0.9 | isc | isc licen[sc]e
mpl | 90 | 0.99 | mpl | spdx licen[sc]e identifier mpl [12] [01]
mpl | 88 | 0.98 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e V
mpl | 86 | 0.97 | mozilla | mozilla org mpl(?: 2 0)?
mpl | 75 | 0.95 | mozilla | licensed under(?: the)?(?: terms of)?(?: the)? mozilla public licen[sc]e V
mpl | 70 | 0.95 | mozilla | mozilla public licen[sc]e V
mpl | 40 | 0.75 | mpl | mpl ?v?[12](?: [01])?
mpl | 30 | 0.5 | mpl | mpl
epl | 90 | 0.99 | epl | spdx licen[sc]e identifier epl [12] 0
epl | 88 | 0.98 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e V
epl | 86 | 0.97 | eclipse | eclipse org legal epl(?: v10| v20| 2 0)?(?: html)?
epl | 70 | 0.95 | eclipse | eclipse public licen[sc]e V
epl | 40 | 0.7 | epl | epl ?v?[12](?: 0)?
edl | 72 | 0.9 | eclipse | eclipse distribution licen[sc]e V
cpl | 72 | 0.9 | common | common public licen[sc]e V
ipl | 72 | 0.9 | ibm | ibm public licen[sc]e V
cddl | 90 | 0.99 | cddl | spdx licen[sc]e identifier cddl 1 [01]
cddl | 72 | 0.95 | common | common development and distribution licen[sc]e V
cddl | 40 | 0.8 | cddl | cddl V
eupl | 90 | 0.99 | eupl | spdx licen[sc]e identifier eupl 1 [012]
eupl | 72 | 0.95 | european | european union public licen[sc]e V
eupl | 40 | 0.8 | eupl | eupl V
osl | 90 | 0.99 | osl | spdx licen[sc]e identifier osl [123] [01]
osl | 72 | 0.9 | open | open software licen[sc]e V
afl | 90 | 0.99 | afl | spdx licen[sc]e identifier afl [123] [01]
afl | 72 | 0.9 | academic | academic free licen[sc]e V
artistic | 90 | 0.99 | artistic | spdx licen[sc]e identifier artistic [12] 0(?: perl)?
artistic | 75 | 0.9 | perl | under the same terms as perl(?: itself)?
artistic | 72 | 0.9 | artistic | artistic licen[sc]e V
boost | 90 | 0.99 | bsl | spdx licen[sc]e identifier bsl 1 0
boost | 86 | 0.97 | boost | boost org licen[sc]e 1 0(?: txt)?
boost | 72 | 0.95 | boost | boost software licen[sc]e V
zlib | 90 | 0.99 | zlib | spdx licen[sc]e identifier zlib
zlib | 88 | 0.95 | misrepresented | the origin of this software must not be misrepresented
zlib | 72 | 0.95 | zlib | zlib(?: libpng)? licen[sc]e
libpng | 72 | 0.9 | libpng | libpng licen[sc]e
unlicense | 90 | 0.99 | unlicense | spdx licen[sc]e identifier unlicense
unlicense | 88 | 0.97 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 86 | 0.95 | unlicense | unlicense org
unlicense | 70 | 0.9 | unlicense | the unlicense
wtfpl | 90 | 0.99 | wtfpl | spdx licen[sc]e identifier wtfpl
wtfpl | 72 | 0.95 | fuck | do what the fuck you want to public licen[sc]e V
wtfpl | 40 | 0.9 | wtfpl | wtfpl V
cc0 | 90 | 0.99 | cc0 | spdx licen[sc]e identifier cc0 1 0
cc0 | 86 | 0.98 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
cc0 | 72 | 0.95 | cc0 | cc0 1 0(?: universal)?
cc0 | 65 | 0.9 | cc0 | cc0(?: public domain dedication)?
cc0 | 66 | 0.9 | zero | creative commons zero(?: v?1 0)?
public-domain | 86 | 0.97 | creativecommons | creativecommons org publicdomain mark(?: 1 0)?
public-domain | 76 | 0.9 | dedicated | dedicated to the public domain
public-domain | 76 | 0.9 | released | released (?:in|into|to) the public domain
public-domain | 76 | 0.85 | placed | placed in(?:to)? the public domain
public-domain | 60 | 0.8 | public | (?:is|are) in the public domain
public-domain | 55 | 0.7 | public | public domain dedication
cc-by-nc-nd | 92 | 0.99 | cc | spdx licen[sc]e identifier cc by nc nd [1234] [05]
cc-by-nc-sa | 92 | 0.99 | cc | spdx licen[sc]e identifier cc by nc sa [1234] [05]
cc-by-nc | 91 | 0.99 | cc | spdx licen[sc]e identifier cc by nc [1234] [05]
cc-by-nd | 91 | 0.99 | cc | spdx licen[sc]e identifier cc by nd [1234] [05]
cc-by-sa | 91 | 0.99 | cc | spdx licen[sc]e identifier cc by sa [1234] [05]
cc-by | 90 | 0.99 | cc | spdx licen[sc]e identifier cc by [1234] [05]
cc-by-nc-nd | 88 | 0.98 | creativecommons | creativecommons org licenses by nc nd(?: [1234] [05])?
cc-by-nc-sa | 88 | 0.98 | creativecommons | creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc | 87 | 0.98 | creativecommons | creativecommons org licenses by nc(?: [1234] [05])?
cc-by-nd | 87 | 0.98 | creativecommons | creativecommons org licenses by nd(?: [1234] [05])?
cc-by-sa | 87 | 0.98 | creativecommons | creativecommons org licenses by sa(?: [1234] [05])?
cc-by | 86 | 0.98 | creativecommons | creativecommons org licenses by(?: [1234] [05])?
cc-by-nc-nd | 78 | 0.95 | noncommercial,commercial | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
cc-by-nc-sa | 78 | 0.95 | noncommercial,commercial | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc | 77 | 0.95 | noncommercial,commercial | creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nd | 77 | 0.95 | attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
cc-by-sa | 77 | 0.95 | attribution | creative commons attribution share ?alike(?: [1234] [05])?
cc-by | 76 | 0.95 | attribution | creative commons attribution(?: [1234] [05])?(?: international)?
cc-by-nc-nd | 68 | 0.9 | cc | cc by nc nd(?: [1234] [05])?
cc-by-nc-sa | 68 | 0.9 | cc | cc by nc sa(?: [1234] [05])?
cc-by-nc | 67 | 0.9 | cc | cc by nc(?: [1234] [05])?
cc-by-nd | 67 | 0.9 | cc | cc by nd(?: [1234] [05])?
cc-by-sa | 67 | 0.9 | cc | cc by sa(?: [1234] [05])?
cc-by | 66 | 0.85 | cc | cc by(?: [1234] [05])?
creative-commons | 50 | 0.6 | commons | creative commons licen[sc]e
creative-commons | 20 | 0.4 | commons | creative commons
odbl | 90 | 0.99 | odbl | spdx licen[sc]e identifier odbl 1 0
odbl | 72 | 0.95 | database | open database licen[sc]e V
odbl | 40 | 0.8 | odbl | odbl V
odc-by | 72 | 0.95 | commons | open data commons attribution licen[sc]e V
pddl | 72 | 0.95 | commons | open data commons public domain dedication(?: and licen[sc]e)? V
cdla | 72 | 0.9 | community | community data licen[sc]e agreement (?:permissive|sharing) V
ofl | 90 | 0.99 | ofl | spdx licen[sc]e identifier ofl 1 [01]
ofl | 75 | 0.95 | sil | sil open font licen[sc]e V
ofl | 70 | 0.9 | font | open font licen[sc]e V
python | 90 | 0.99 | psf | spdx licen[sc]e identifier psf 2 0
python | 72 | 0.9 | python | python software foundation licen[sc]e V
php | 72 | 0.9 | php | php licen[sc]e V
ruby | 72 | 0.9 | ruby | ruby licen[sc]e
postgresql | 90 | 0.99 | postgresql | spdx licen[sc]e identifier postgresql
postgresql | 72 | 0.9 | postgresql | postgresql licen[sc]e
openssl | 72 | 0.9 | openssl | openssl licen[sc]e
curl | 72 | 0.9 | curl | curl licen[sc]e
vim | 72 | 0.9 | vim | vim licen[sc]e
tcl | 72 | 0.9 | tcl | tcl tk licen[sc]e
json | 72 | 0.9 | json | json licen[sc]e
json | 84 | 0.9 | evil | the software shall be used for good not evil
beerware | 74 | 0.9 | beer | beer ware licen[sc]e
icu | 72 | 0.9 | icu | icu licen[sc]e
unicode | 72 | 0.9 | unicode | unicode(?: data files and software)? licen[sc]e(?: agreement)?
w3c | 72 | 0.9 | w3c | w3c software(?: notice)?(?: and)?(?: document)? licen[sc]e
ncsa | 72 | 0.9 | ncsa | university of illinois ncsa open source licen[sc]e
ncsa | 65 | 0.85 | ncsa | ncsa(?: open source)? licen[sc]e
ms-pl | 72 | 0.9 | microsoft | microsoft public licen[sc]e
ms-rl | 72 | 0.9 | microsoft | microsoft reciprocal licen[sc]e
ecl | 72 | 0.9 | educational | educational community licen[sc]e V
upl | 72 | 0.9 | universal | universal permissive licen[sc]e V
mulan | 72 | 0.9 | mulan | mulan psl V
mulan | 72 | 0.9 | mulan | mulan permissive software licen[sc]e V
cecill | 72 | 0.9 | cecill | cecill(?: [abc])?(?: licen[sc]e)? V
eiffel | 72 | 0.85 | eiffel | eiffel forum licen[sc]e V
sleepycat | 72 | 0.9 | sleepycat | sleepycat(?: public)? licen[sc]e
qpl | 72 | 0.9 | q public | q public licen[sc]e V
lppl | 72 | 0.9 | latex | latex project public licen[sc]e V
nasa | 72 | 0.85 | nasa | nasa open source agreement V
apsl | 72 | 0.9 | apple | apple public source licen[sc]e V
netscape | 72 | 0.85 | netscape | netscape public licen[sc]e V
ogl | 72 | 0.85 | government | open government licen[sc]e V
elastic | 72 | 0.9 | elastic | elastic licen[sc]e V
sspl | 72 | 0.95 | server | server side public licen[sc]e V
sspl | 40 | 0.8 | sspl | sspl V
busl | 72 | 0.9 | business | business source licen[sc]e V
commons-clause | 72 | 0.9 | commons | commons clause(?: licen[sc]e condition)? V
confluent | 72 | 0.9 | confluent | confluent community licen[sc]e V
polyform | 72 | 0.9 | polyform | polyform noncommercial licen[sc]e V
polyform | 72 | 0.9 | polyform | polyform small business licen[sc]e V
polyform | 72 | 0.9 | polyform | polyform (?:strict|shield|perimeter|internal use) licen[sc]e V
openrail | 72 | 0.9 | creativeml | creativeml open ?rail(?: [ms])?(?: licen[sc]e)?
openrail | 72 | 0.9 | bigscience | bigscience(?: bloom)? open ?rail(?: m)?(?: licen[sc]e)?
openrail | 72 | 0.9 | bigcode | bigcode open ?rail(?: m)?(?: licen[sc]e)?
openrail | 60 | 0.8 | rail | open ?rail(?: [ms])? licen[sc]e
llama | 72 | 0.9 | llama | llama(?: [234])? community licen[sc]e(?: agreement)?
gemma | 72 | 0.85 | gemma | gemma terms of use
proprietary | 84 | 0.9 | confidential | proprietary and confidential
proprietary | 84 | 0.9 | unauthorized | unauthorized copying of this (?:file|software) via any medium is strictly prohibited
proprietary | 60 | 0.6 | agreement | end user licen[sc]e agreement
proprietary | 50 | 0.5 | commercial | commercial licen[sc]e
proprietary | 50 | 0.5 | proprietary | proprietary licen[sc]e
proprietary | 40 | 0.4 | reserved | all rights reserved
proprietary | 40 | 0.4 | reproduced | no part of this publication may be reproduced
"""

_WORD = r"0-9a-z\x80-\xff"
_GAP = rf"[^{_WORD}]+"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]
    confidence: float


def _compiled(text: str) -> re.Pattern[bytes]:
    text = text.replace(" V", rf"(?:{_GAP}(?:version{_GAP}|v)?[0-9](?:\.[0-9])*(?:{_GAP}or{_GAP}later)?)?")
    text = re.sub(r"(?<![\\{}])  *(?!\?)", lambda _: _GAP, text).replace(" ?", f"(?:{_GAP})?")
    return re.compile(rf"(?<![{_WORD}])(?:{text})(?![{_WORD}])".encode("latin-1"), re.DOTALL)


def fields(line: str) -> list[str]:
    """Label, priority, confidence, keywords, pattern; the pattern may hold bars."""
    return [x.strip() for x in line.split("|", 4)]


def build_rules(signatures: str = SIGNATURES) -> list[Rule]:
    """Rules by falling priority; of equal ones the earlier line goes first."""
    rules = []
    for line in signatures.strip().splitlines():
        label, priority, confidence, keywords, pattern = fields(line)
        rules.append(Rule(label, int(priority), _compiled(pattern), tuple(k.strip().encode() for k in keywords.split(",")), float(confidence)))
    return sorted(rules, key=lambda r: -r.priority)


RULES = build_rules()
_BASES = [(p.encode(), re.compile(rf"(?<![{_WORD}]){_GAP.join(p.split())}(?![{_WORD}])".encode("latin-1")), label) for p, label in BASE.items()]
#: Blanks for all bytes that belong to no word.
_BLANKS = bytes(c if re.match(f"[{_WORD}]", chr(c)) else 0x20 for c in range(256))


def folded(lowered: bytes) -> bytes:
    """The words with one blank between them: where keywords are sought."""
    return b" ".join(lowered.translate(_BLANKS).split())


def detections(lowered: bytes, rules: list[Rule] = RULES, words: bytes | None = None) -> list[tuple[int, int, Rule]]:
    """Kept (start, end, rule) byte intervals after suppression, by start; ``words``: ``folded`` if it is known."""
    words = folded(lowered) if words is None else words
    gate: dict[bytes, bool] = {}
    found = []
    for rule in rules:
        for key in rule.keywords:
            if key not in gate:
                gate[key] = key in words
        if any(gate[k] for k in rule.keywords):
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(lowered)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0]))
    kept: list[tuple[int, int, Rule]] = []  # disjoint, by start
    starts: list[int] = []
    for a, b, rule in found:
        k = bisect.bisect_left(starts, b)  # the last taken one that begins before this ends
        if not k or kept[k - 1][1] <= a:
            starts.insert(k, a)
            kept.insert(k, (a, b, rule))
    return kept


def base_places(lowered: bytes, words: bytes | None = None) -> list[tuple[int, str]]:
    words = folded(lowered) if words is None else words
    return [(m.start(), label) for phrase, pattern, label in _BASES if phrase in words for m in pattern.finditer(lowered)]


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detected", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column(batch.schema.get_field_index("doc_id"))
        for a, b, data, offsets in spans(strings(batch, "text")):
            words = Words(data, offsets, IS_SYMBOL)
            lowered = data.tobytes().lower()
            rows = []
            for k in range(b - a):
                body = lowered[offsets[k] : offsets[k + 1]]
                held = folded(body)
                places, kept = base_places(body, held), detections(body, words=held)
                if not places and not kept:
                    rows.append((0, None, None, "", "", 0.0, ""))
                    continue
                starts = words.start[words.bounds[k] : words.bounds[k + 1]] - offsets[k]
                at = np.searchsorted(starts, sorted(p for p, _ in places))
                base = {label for _, label in places}
                both = base | {r.label for _, _, r in kept}
                spotted = ";".join(f"{r.label}@{np.searchsorted(starts, x)}" for x, _, r in kept)
                score = 1.0 - float(np.prod([1 - r.confidence for _, _, r in kept])) if kept else (0.5 if base else 0.0)
                rows.append((len(places), int(at[0]) if places else None, int(at[-1]) if places else None, ",".join(sorted(base)), ",".join(sorted(both)), score, spotted))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), pa.array(words.counts(), pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(_FOUND)[2:])]], schema=_FOUND)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: base places and labels, all labels, score, and kept detections as label@word."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detected string")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
