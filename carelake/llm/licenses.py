"""License scans: ordered signature rules gated by keywords, with suppression of contained hits.

A text is lower-cased (A-Z in effect: letters beyond ASCII only ever form words of
their own) and reduced to its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with single
spaces around each. A rule is a gate and a keyword, a regular expression over that
form, a label, a priority and a confidence. Only rules whose gate and keyword both
occur are run, and texts without any gate meet no rule at all: both are part of
every text that the pattern can match, so no hit is lost by them. A hit
that lies inside a hit of another rule is dropped if that one is longer and no lower
in priority, or higher in priority.

Positions and suppression are running scans over a text's hits in order, in time
that grows with their number.

Cases: null text counts as empty (no words, no labels, score 0); repeated rows are
each scanned; an empty table gives an empty result; other columns are never read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items that a scan takes at once.
STRIDE = 256


class Signature(NamedTuple):
    gate: str
    keyword: str
    label: str
    priority: int
    confidence: float
    pattern: str


#: The rules in order: gate, keyword, label, priority, confidence, pattern.
RULES = r"""
# SPDX identifiers
spdx | apache 2 0 | apache-2.0 | 100 | 0.99 | spdx license identifier apache 2 0
spdx | apache 1 1 | apache-1.1 | 100 | 0.99 | spdx license identifier apache 1 1
spdx | identifier mit | mit | 100 | 0.99 | spdx license identifier mit(?: 0)?
spdx | identifier x11 | x11 | 100 | 0.99 | spdx license identifier x11
spdx | identifier isc | isc | 100 | 0.99 | spdx license identifier isc
spdx | bsd 2 clause | bsd-2-clause | 100 | 0.99 | spdx license identifier bsd 2 clause(?: patent)?
spdx | bsd 3 clause | bsd-3-clause | 100 | 0.99 | spdx license identifier bsd 3 clause(?: clear)?
spdx | bsd 4 clause | bsd-4-clause | 100 | 0.99 | spdx license identifier bsd 4 clause(?: uc)?
spdx | 0bsd | 0bsd | 100 | 0.99 | spdx license identifier 0bsd
spdx | identifier gpl 1 0 | gpl-1 | 100 | 0.99 | spdx license identifier gpl 1 0(?: only| or later)?
spdx | identifier gpl 2 0 | gpl-2 | 100 | 0.99 | spdx license identifier gpl 2 0(?: only| or later)?
spdx | identifier gpl 3 0 | gpl-3 | 100 | 0.99 | spdx license identifier gpl 3 0(?: only| or later)?
spdx | lgpl 2 0 | lgpl-2 | 100 | 0.99 | spdx license identifier lgpl 2 0(?: only| or later)?
spdx | lgpl 2 1 | lgpl-2.1 | 100 | 0.99 | spdx license identifier lgpl 2 1(?: only| or later)?
spdx | lgpl 3 0 | lgpl-3 | 100 | 0.99 | spdx license identifier lgpl 3 0(?: only| or later)?
spdx | agpl 1 0 | agpl-1 | 100 | 0.99 | spdx license identifier agpl 1 0(?: only| or later)?
spdx | agpl 3 0 | agpl-3 | 100 | 0.99 | spdx license identifier agpl 3 0(?: only| or later)?
spdx | gfdl 1 | gfdl | 100 | 0.99 | spdx license identifier gfdl 1 [123](?: only| or later)?
spdx | mpl 1 1 | mpl-1.1 | 100 | 0.99 | spdx license identifier mpl 1 1
spdx | mpl 2 0 | mpl-2.0 | 100 | 0.99 | spdx license identifier mpl 2 0(?: no copyleft exception)?
spdx | epl 1 0 | epl-1.0 | 100 | 0.99 | spdx license identifier epl 1 0
spdx | epl 2 0 | epl-2.0 | 100 | 0.99 | spdx license identifier epl 2 0
spdx | cddl 1 | cddl | 100 | 0.99 | spdx license identifier cddl 1 [01]
spdx | eupl 1 | eupl | 100 | 0.99 | spdx license identifier eupl 1 [012]
spdx | osl 3 0 | osl-3.0 | 100 | 0.99 | spdx license identifier osl 3 0
spdx | afl 3 0 | afl-3.0 | 100 | 0.99 | spdx license identifier afl 3 0
spdx | artistic | artistic | 100 | 0.99 | spdx license identifier artistic [12] 0
spdx | bsl 1 0 | bsl-1.0 | 100 | 0.99 | spdx license identifier bsl 1 0
spdx | busl 1 1 | busl-1.1 | 100 | 0.99 | spdx license identifier busl 1 1
spdx | zlib | zlib | 100 | 0.99 | spdx license identifier zlib
spdx | unlicense | unlicense | 100 | 0.99 | spdx license identifier unlicense
spdx | wtfpl | wtfpl | 100 | 0.99 | spdx license identifier wtfpl
spdx | ofl 1 | ofl | 100 | 0.99 | spdx license identifier ofl 1 [01](?: rfn)?
spdx | odbl 1 0 | odbl | 100 | 0.99 | spdx license identifier odbl 1 0
spdx | cc0 1 0 | cc0 | 100 | 0.99 | spdx license identifier cc0 1 0
spdx | cc by 3 0 | cc-by-3.0 | 100 | 0.99 | spdx license identifier cc by 3 0
spdx | cc by 4 0 | cc-by-4.0 | 100 | 0.99 | spdx license identifier cc by 4 0
spdx | cc by sa | cc-by-sa | 100 | 0.99 | spdx license identifier cc by sa (?:2 0|2 5|3 0|4 0)
spdx | cc by nc | cc-by-nc | 100 | 0.99 | spdx license identifier cc by nc (?:2 0|2 5|3 0|4 0)
spdx | cc by nc sa | cc-by-nc-sa | 100 | 0.99 | spdx license identifier cc by nc sa (?:2 0|2 5|3 0|4 0)
spdx | cc by nc nd | cc-by-nc-nd | 100 | 0.99 | spdx license identifier cc by nc nd (?:2 0|2 5|3 0|4 0)
spdx | cc by nd | cc-by-nd | 100 | 0.99 | spdx license identifier cc by nd (?:2 0|2 5|3 0|4 0)
spdx | identifier psf | psf | 100 | 0.99 | spdx license identifier psf 2 0
spdx | identifier ncsa | ncsa | 100 | 0.99 | spdx license identifier ncsa
spdx | postgresql | postgresql | 100 | 0.99 | spdx license identifier postgresql
spdx | identifier curl | curl | 100 | 0.99 | spdx license identifier curl
spdx | sspl 1 0 | sspl | 100 | 0.99 | spdx license identifier sspl 1 0
spdx | elastic 2 0 | elastic-2.0 | 100 | 0.99 | spdx license identifier elastic 2 0
spdx | spdx license identifier | spdx-other | 20 | 0.5 | spdx license identifier

# the GNU family
general public | general public license version 1 | gpl-1 | 80 | 0.9 | gnu general public license version 1
general public | general public licen | gpl-2 | 80 | 0.92 | (?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?
general public | general public licen | gpl-3 | 80 | 0.92 | (?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?
general public | version 2 of the | gpl-2 | 80 | 0.92 | version 2 of the (?:gnu )?general public licen[cs]e
general public | version 3 of the | gpl-3 | 80 | 0.92 | version 3 of the (?:gnu )?general public licen[cs]e
general public | general public | gpl | 60 | 0.85 | gnu general public licen[cs]e
general public | general public | gpl | 45 | 0.7 | general public licen[cs]e
general public | lesser general public | lgpl-2.1 | 82 | 0.92 | (?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1
general public | lesser general public | lgpl-3 | 82 | 0.92 | (?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?
general public | lesser general public | lgpl | 62 | 0.85 | (?:gnu )?lesser general public licen[cs]e
general public | library general public | lgpl-2 | 82 | 0.92 | (?:gnu )?library general public licen[cs]e (?:version |v)?2(?: 0)?
general public | library general public | lgpl | 62 | 0.85 | (?:gnu )?library general public licen[cs]e
general public | affero general public | agpl-1 | 82 | 0.9 | affero general public licen[cs]e (?:version |v)?1(?: 0)?
general public | affero general public | agpl-3 | 82 | 0.92 | (?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?
general public | affero general public | agpl | 62 | 0.85 | (?:gnu )?affero general public licen[cs]e
free documentation | free documentation | gfdl | 62 | 0.85 | (?:gnu )?free documentation licen[cs]e
free documentation | free documentation | gfdl-1.1 | 82 | 0.92 | (?:gnu )?free documentation licen[cs]e (?:version |v)?1 1
free documentation | free documentation | gfdl-1.2 | 82 | 0.92 | (?:gnu )?free documentation licen[cs]e (?:version |v)?1 2
free documentation | free documentation | gfdl-1.3 | 82 | 0.92 | (?:gnu )?free documentation licen[cs]e (?:version |v)?1 3
free software | you can redistribute it and or modify | gpl | 85 | 0.9 | this (?:program|library|file) is free software you can redistribute it and or modify
free software | free software foundation | gpl | 30 | 0.6 | as published by the free software foundation
free software | either version 2 | gpl-2 | 84 | 0.92 | published by the free software foundation either version 2
free software | either version 3 | gpl-3 | 84 | 0.92 | published by the free software foundation either version 3
 gpl | gpl | gpl-2 | 66 | 0.85 | (?:gnu )?gpl ?v?2(?: 0)?
 gpl | gpl | gpl-3 | 66 | 0.85 | (?:gnu )?gpl ?v?3(?: 0)?
 gpl | gpl licen | gpl | 55 | 0.8 | gpl licen[cs]ed?
 gplv | gplv2 | gpl-2 | 66 | 0.85 | gplv2
 gplv | gplv3 | gpl-3 | 66 | 0.85 | gplv3
lgpl | lgpl | lgpl-2.1 | 66 | 0.85 | lgpl ?v?2 1
lgpl | lgpl | lgpl-3 | 66 | 0.85 | lgpl ?v?3(?: 0)?
lgpl | lgpl licen | lgpl | 55 | 0.8 | lgpl licen[cs]ed?
agpl | agpl | agpl-3 | 66 | 0.85 | agpl ?v?3(?: 0)?
agpl | agpl licen | agpl | 55 | 0.8 | agpl licen[cs]ed?
linking exception | classpath exception | classpath-exception | 70 | 0.85 | (?:gnu )?classpath exception(?: to the gpl)? linking exception
classpath | classpath exception | classpath-exception | 65 | 0.8 | classpath exception

# Apache
apache | apache | apache-1.0 | 80 | 0.92 | apache (?:software )?licen[cs]e (?:version |v)?1 0
apache | apache | apache-1.1 | 80 | 0.92 | apache (?:software )?licen[cs]e (?:version |v)?1 1
apache | apache | apache-2.0 | 80 | 0.94 | apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?
apache | version 2 0 of the apache | apache-2.0 | 80 | 0.92 | version 2 0 of the apache licen[cs]e
apache | apache 2 | apache-2.0 | 66 | 0.85 | apache 2(?: 0)? licen[cs]ed?
apache | under the apache | apache | 65 | 0.85 | licen[cs]ed under the apache(?: software)? licen[cs]e
apache | apache | apache | 45 | 0.8 | apache (?:software )?licen[cs]e
apache | licenses license 2 0 | apache-2.0 | 90 | 0.97 | www apache org licenses license 2 0
apache | apache software foundation | apache | 30 | 0.55 | licen[cs]ed to the apache software foundation

# MIT, X11, ISC and kin
permission | hereby granted free of charge | mit | 92 | 0.96 | permission is hereby granted free of charge to any person obtaining a copy
permission | to deal in the software | mit | 88 | 0.93 | permission(?: is hereby granted)? to deal in the software without restriction
the above copyright notice and this permission | the above copyright notice and this permission | mit | 70 | 0.85 | the above copyright notice and this permission notice shall be included
 mit | mit licen | mit | 50 | 0.85 | (?:the )?mit licen[cs]e
 mit | mit licen | mit | 66 | 0.9 | (?:licen[cs]ed|released|distributed|available) under the (?:terms of the )?mit licen[cs]e
 mit | mit style | mit | 40 | 0.6 | mit style licen[cs]e
 x11 | x11 licen | x11 | 55 | 0.85 | (?:the )?x11 licen[cs]e
x consortium | x consortium | x11 | 70 | 0.85 | the name of the x consortium shall not be used in advertising
expat | expat licen | mit | 50 | 0.8 | expat licen[cs]e
permission | permission to use copy modify and | isc | 90 | 0.95 | permission to use copy modify and or distribute this software for any purpose
permission | permission to use copy modify and | historical-permission | 85 | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose
 isc | isc licen | isc | 50 | 0.85 | (?:the )?isc licen[cs]e
without fee | is hereby granted without fee | historical-permission | 60 | 0.7 | is hereby granted without fee
sell this software | sell this software | historical-permission | 65 | 0.75 | (?:copy )?modify distribute and sell this software

# BSD
redistribution | redistribution and use in source and binary forms | bsd | 80 | 0.92 | redistribution and use in source and binary forms with or without modification are permitted
redistributions | redistributions of source code | bsd | 80 | 0.9 | redistributions of source code must retain the above copyright notice
redistributions | redistributions in binary form | bsd | 80 | 0.9 | redistributions in binary form must reproduce the above copyright notice
endorse | endorse or promote products | bsd-3-clause | 88 | 0.93 | may be used to endorse or promote products derived from this software
endorse | contributors may be used to endorse | bsd-3-clause | 90 | 0.95 | neither the name of (?:\w+ ){1,8}nor the names of its contributors may be used to endorse
advertising | all advertising materials | bsd-4-clause | 90 | 0.95 | all advertising materials mentioning features or use of this software
bsd | bsd | bsd | 50 | 0.8 | (?:the )?bsd licen[cs]e
bsd | bsd 0 clause | 0bsd | 60 | 0.85 | bsd 0 clause(?: licen[cs]e)?
bsd | 2 clause | bsd-2-clause | 60 | 0.85 | (?:the )?(?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd | 3 clause | bsd-3-clause | 60 | 0.85 | (?:the )?(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd | 4 clause | bsd-4-clause | 60 | 0.85 | (?:the )?(?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
bsd | simplified bsd | bsd-2-clause | 60 | 0.85 | simplified bsd licen[cs]e
bsd | freebsd licen | bsd-2-clause | 60 | 0.8 | freebsd licen[cs]e
bsd | new bsd | bsd-3-clause | 60 | 0.85 | new bsd licen[cs]e
bsd | modified bsd | bsd-3-clause | 60 | 0.85 | modified bsd licen[cs]e
bsd | revised bsd | bsd-3-clause | 60 | 0.85 | revised bsd licen[cs]e
bsd | bsd style | bsd | 45 | 0.65 | bsd style licen[cs]e

# Mozilla, Eclipse and other weak copyleft
mozilla | mozilla public | mpl-1.0 | 80 | 0.92 | mozilla public licen[cs]e (?:version |v)?1 0
mozilla | mozilla public | mpl-1.1 | 80 | 0.92 | mozilla public licen[cs]e (?:version |v)?1 1
mozilla | mozilla public | mpl-2.0 | 80 | 0.92 | mozilla public licen[cs]e (?:version |v)?2(?: 0)?
mozilla | mozilla public | mpl | 60 | 0.85 | mozilla public licen[cs]e
mozilla | mozilla org mpl 2 0 | mpl-2.0 | 88 | 0.95 | mozilla org mpl 2 0
subject to the terms | subject to the terms of the mozilla | mpl | 70 | 0.9 | this source code form is subject to the terms of the mozilla public licen[cs]e
eclipse | eclipse public | epl-1.0 | 80 | 0.92 | eclipse public licen[cs]e (?:version |v)?1 0
eclipse | eclipse public | epl-2.0 | 80 | 0.92 | eclipse public licen[cs]e (?:version |v)?2(?: 0)?
eclipse | eclipse public | epl | 60 | 0.85 | eclipse public licen[cs]e
eclipse | eclipse distribution | edl | 60 | 0.85 | eclipse distribution licen[cs]e(?: v?1 0)?
common development | common development | cddl | 70 | 0.88 | common development and distribution licen[cs]e
 cddl | cddl | cddl | 55 | 0.8 | cddl(?: licen[cs]e)?(?: v?1 [01])?
common public | common public licen | cpl | 60 | 0.85 | common public licen[cs]e(?: (?:version |v)?1 0)?
common public | common public attribution | cpal | 62 | 0.88 | common public attribution licen[cs]e
ibm public | ibm public licen | ipl | 60 | 0.85 | ibm public licen[cs]e
european union public | european union public | eupl | 62 | 0.88 | european union public licen[cs]e
 eupl | eupl | eupl | 50 | 0.75 | eupl(?: v?1 [012])?
open software licen | open software licen | osl | 60 | 0.85 | open software licen[cs]e
open software licen | open software licen | osl-3.0 | 80 | 0.92 | open software licen[cs]e (?:version |v)?3 0
academic free | academic free licen | afl | 60 | 0.85 | academic free licen[cs]e
academic free | academic free licen | afl-3.0 | 80 | 0.92 | academic free licen[cs]e (?:version |v)?3 0
artistic licen | artistic licen | artistic | 60 | 0.82 | artistic licen[cs]e
artistic licen | artistic licen | artistic-2.0 | 80 | 0.92 | artistic licen[cs]e (?:version |v)?2(?: 0)?
clarified artistic | clarified artistic | artistic-clarified | 62 | 0.85 | clarified artistic licen[cs]e
reciprocal | microsoft reciprocal | ms-rl | 62 | 0.88 | microsoft reciprocal licen[cs]e
reciprocal | reciprocal public | rpl | 62 | 0.88 | reciprocal public licen[cs]e
microsoft | microsoft public | ms-pl | 62 | 0.88 | microsoft public licen[cs]e
microsoft | microsoft limited public | ms-lpl | 62 | 0.88 | microsoft limited public licen[cs]e
cecill | cecill | cecill | 60 | 0.85 | cecill(?: [bc])?(?: free software)? licen[cs]e
mulan | mulan | mulan-psl | 60 | 0.85 | mulan permissive software licen[cs]e
sleepycat | sleepycat | sleepycat | 60 | 0.85 | sleepycat licen[cs]e
q public | q public licen | qpl | 60 | 0.85 | q public licen[cs]e
sun industry | sun industry | sissl | 62 | 0.88 | sun industry standards source licen[cs]e
sun public | sun public licen | spl | 60 | 0.85 | sun public licen[cs]e
apple public | apple public | apsl | 60 | 0.85 | apple public source licen[cs]e
nokia open | nokia open source | nokia | 60 | 0.85 | nokia open source licen[cs]e
lucent public | lucent public | lpl | 60 | 0.85 | lucent public licen[cs]e
ricoh source | ricoh source | rscpl | 60 | 0.85 | ricoh source code public licen[cs]e
motosoto | motosoto | motosoto | 60 | 0.85 | motosoto open source licen[cs]e
netscape public | netscape public | npl | 60 | 0.85 | netscape public licen[cs]e
latex project | latex project public | lppl | 62 | 0.88 | latex project public licen[cs]e
erlang public | erlang public | erlpl | 60 | 0.85 | erlang public licen[cs]e
zope public | zope public | zpl | 60 | 0.85 | zope public licen[cs]e
non profit open | non profit open | nposl | 60 | 0.85 | non profit open software licen[cs]e

# other permissive
boost software | boost software licen | bsl-1.0 | 62 | 0.88 | boost software licen[cs]e(?: (?:version |v)?1 0)?
zlib | zlib | zlib | 55 | 0.85 | zlib(?: libpng)? licen[cs]e
misrepresented | must not be misrepresented | zlib | 82 | 0.9 | the origin of this software must not be misrepresented
plainly marked | plainly marked | zlib | 75 | 0.85 | altered source versions must be plainly marked as such
libpng | libpng licen | libpng | 55 | 0.82 | libpng licen[cs]e
libtiff | libtiff licen | libtiff | 55 | 0.82 | libtiff licen[cs]e
freetype | freetype project | ftl | 60 | 0.85 | freetype project licen[cs]e
freetype | freetype licen | ftl | 55 | 0.82 | freetype licen[cs]e
python | python software foundation | psf | 70 | 0.9 | python software foundation licen[cs]e
python | python licen | psf | 50 | 0.75 | python licen[cs]e
php | php licen | php | 60 | 0.85 | php licen[cs]e
zend | zend engine | zend | 60 | 0.85 | zend engine licen[cs]e
openssl | openssl licen | openssl | 60 | 0.85 | openssl licen[cs]e
openssl | developed by the openssl project | openssl | 75 | 0.88 | software developed by the openssl project
ssleay | ssleay licen | openssl | 55 | 0.82 | (?:original )?ssleay licen[cs]e
ruby licen | ruby licen | ruby | 55 | 0.8 | ruby licen[cs]e
perl | same terms as perl itself | perl | 75 | 0.88 | under the same terms as perl itself
vim licen | vim licen | vim | 55 | 0.82 | vim licen[cs]e
illinois | university of illinois | ncsa | 70 | 0.88 | university of illinois (?:\w+ )?ncsa open source licen[cs]e
ncsa | ncsa open source | ncsa | 60 | 0.85 | ncsa open source licen[cs]e
w3c | w3c software | w3c | 60 | 0.85 | w3c software (?:notice and )?(?:document )?licen[cs]e
unicode | unicode licen | unicode | 55 | 0.82 | unicode licen[cs]e(?: agreement)?
icu licen | icu licen | icu | 55 | 0.82 | icu licen[cs]e
postgresql | postgresql licen | postgresql | 55 | 0.85 | postgresql licen[cs]e
curl licen | curl licen | curl | 55 | 0.82 | curl licen[cs]e
beer | buy me a beer | beerware | 85 | 0.92 | you can buy me a beer in return
beer | beerware licen | beerware | 60 | 0.85 | beerware licen[cs]e
json | json licen | json | 55 | 0.82 | json licen[cs]e
good not evil | good not evil | json | 85 | 0.92 | software shall be used for good not evil
educational community | educational community | ecl | 62 | 0.88 | educational community licen[cs]e
blue oak | blue oak model | blueoak | 62 | 0.88 | blue oak model licen[cs]e
universal permissive | universal permissive | upl | 62 | 0.88 | universal permissive licen[cs]e
fair licen | fair licen | fair | 50 | 0.7 | (?:the )?fair licen[cs]e
sil open font | open font licen | ofl | 64 | 0.9 | sil open font licen[cs]e
open font | open font licen | ofl | 60 | 0.86 | open font licen[cs]e(?: (?:version |v)?1 [01])?
open game | open game licen | ogl-game | 60 | 0.85 | open game licen[cs]e
what the | you want to public | wtfpl | 85 | 0.95 | do what the f\w+ you want to public licen[cs]e
wtfpl | wtfpl | wtfpl | 50 | 0.8 | wtfpl

# public domain and dedications
public domain | public domain | public-domain | 70 | 0.85 | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public domain | public domain dedication | public-domain | 60 | 0.8 | public domain dedication
public domain | public domain mark | public-domain | 60 | 0.8 | public domain mark(?: 1 0)?
unencumbered | unencumbered software | unlicense | 95 | 0.98 | this is free and unencumbered software released into the public domain
unlicense | unlicense | unlicense | 55 | 0.85 | (?:the )?unlicense
disclaims copyright | disclaims copyright | blessing | 80 | 0.9 | the author disclaims copyright to this source code
no rights reserved | no rights reserved | public-domain | 60 | 0.8 | no rights reserved
waived all copyright | waived all copyright | cc0 | 70 | 0.85 | has waived all copyright and related (?:or neighboring )?rights

# Creative Commons and open data
creative commons | creative commons | creative-commons | 30 | 0.6 | creative commons licen[cs]e
creative commons | creative commons attribution | cc-by | 60 | 0.85 | creative commons attribution
creative commons | creative commons attribution | cc-by-3.0 | 66 | 0.9 | creative commons attribution (?:licen[cs]e )?3 0
creative commons | creative commons attribution | cc-by-4.0 | 66 | 0.9 | creative commons attribution (?:licen[cs]e )?4 0
creative commons | creative commons attribution share | cc-by-sa | 68 | 0.9 | creative commons attribution share ?alike
creative commons | creative commons attribution share | cc-by-sa-3.0 | 72 | 0.92 | creative commons attribution share ?alike (?:licen[cs]e )?3 0
creative commons | creative commons attribution share | cc-by-sa-4.0 | 72 | 0.92 | creative commons attribution share ?alike (?:licen[cs]e )?4 0
creative commons | creative commons attribution no | cc-by-nd | 68 | 0.9 | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
creative commons | creative commons attribution non | cc-by-nc | 68 | 0.9 | creative commons attribution non ?commercial
creative commons | creative commons attribution non | cc-by-nc-sa | 72 | 0.92 | creative commons attribution non ?commercial share ?alike
creative commons | creative commons attribution non | cc-by-nc-nd | 72 | 0.92 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
creative commons | creative commons | cc0 | 68 | 0.9 | creative commons (?:zero|cc0)
cc0 | cc0 | cc0 | 55 | 0.85 | cc0(?: 1 0)?(?: universal)?
cc by | cc by sa | cc-by-sa | 58 | 0.86 | cc by sa(?: (?:2 0|2 5|3 0|4 0))?
cc by | cc by nc | cc-by-nc | 58 | 0.86 | cc by nc(?: (?:2 0|2 5|3 0|4 0))?
cc by | cc by nc sa | cc-by-nc-sa | 62 | 0.88 | cc by nc sa(?: (?:2 0|2 5|3 0|4 0))?
cc by | cc by nc nd | cc-by-nc-nd | 62 | 0.88 | cc by nc nd(?: (?:2 0|2 5|3 0|4 0))?
cc by | cc by nd | cc-by-nd | 58 | 0.86 | cc by nd(?: (?:2 0|2 5|3 0|4 0))?
cc by | cc by 3 0 | cc-by-3.0 | 58 | 0.86 | cc by 3 0
cc by | cc by 4 0 | cc-by-4.0 | 58 | 0.86 | cc by 4 0
creativecommons | licenses by 4 0 | cc-by-4.0 | 75 | 0.93 | creativecommons org licenses by 4 0
creativecommons | licenses by sa 4 0 | cc-by-sa-4.0 | 75 | 0.93 | creativecommons org licenses by sa 4 0
creativecommons | publicdomain zero | cc0 | 75 | 0.93 | creativecommons org publicdomain zero 1 0
open data | open database licen | odbl | 64 | 0.88 | open data commons open database licen[cs]e
open database | open database licen | odbl | 60 | 0.85 | open database licen[cs]e
open data | odc attribution | odc-by | 62 | 0.86 | open data commons odc attribution licen[cs]e
open data | open data commons attribution | odc-by | 62 | 0.86 | open data commons attribution licen[cs]e
open data | public domain dedication and | pddl | 72 | 0.88 | open data commons public domain dedication and licen[cs]e
open government | open government licen | ogl | 60 | 0.86 | open government licen[cs]e(?: v?[123](?: 0)?)?
community data | community data licen | cdla | 60 | 0.86 | community data licen[cs]e agreement

# source available
business source | business source licen | busl-1.1 | 80 | 0.92 | business source licen[cs]e (?:version |v)?1 1
business source | business source licen | busl | 60 | 0.86 | business source licen[cs]e
server side public | server side public | sspl | 62 | 0.88 | server side public licen[cs]e
elastic licen | elastic licen | elastic-2.0 | 66 | 0.88 | elastic licen[cs]e (?:version |v)?2(?: 0)?
elastic licen | elastic licen | elastic | 50 | 0.78 | elastic licen[cs]e
commons clause | commons clause | commons-clause | 62 | 0.86 | commons clause(?: licen[cs]e)?(?: condition)?
polyform | polyform | polyform | 60 | 0.86 | polyform (?:noncommercial|strict|shield|perimeter|small business|free trial|internal use) licen[cs]e
confluent community | confluent community | ccl | 60 | 0.86 | confluent community licen[cs]e
redis source | redis source available | rsal | 60 | 0.86 | redis source available licen[cs]e
timescale licen | timescale licen | tsl | 60 | 0.86 | timescale licen[cs]e
responsible ai | responsible ai licen | rail | 60 | 0.86 | (?:open )?responsible ai licen[cs]e

# proprietary notices, disclaimers and copyright lines
proprietary | proprietary and confidential | proprietary | 60 | 0.8 | proprietary and confidential
proprietary | confidential and proprietary | proprietary | 60 | 0.8 | confidential and proprietary
proprietary | proprietary software | proprietary | 50 | 0.7 | (?:this is )?proprietary software
proprietary | proprietary licen | proprietary | 50 | 0.7 | proprietary licen[cs]e
trade secret | trade secret | proprietary | 55 | 0.75 | (?:contains|valuable|and) trade secrets?
unauthorized | unauthorized copying | proprietary | 60 | 0.85 | unauthorized copying of this file
unauthorized | unauthorized | proprietary | 60 | 0.85 | unauthorized (?:copying|reproduction|distribution) (?:\w+ ){0,4}(?:prohibited|forbidden)
may not be reproduced | may not be reproduced | proprietary | 55 | 0.75 | may not be reproduced (?:or (?:\w+ ){1,3})?without (?:the )?(?:prior |express )?written permission
end user licen | end user licen | eula | 55 | 0.8 | end user licen[cs]e agreement
for internal use only | for internal use only | proprietary | 45 | 0.65 | for internal use only
non commercial | non commercial use only | non-commercial | 55 | 0.75 | (?:for )?non commercial use only
commercial licen | commercial licen | commercial | 40 | 0.6 | commercial licen[cs]e
shareware | shareware | shareware | 40 | 0.6 | (?:this is )?shareware
freeware | freeware | freeware | 40 | 0.6 | (?:this is )?freeware
as is | is provided as is | as-is-disclaimer | 30 | 0.5 | (?:software|work) is provided as is without warranty of any kind
as is | provided as is with all | as-is-disclaimer | 30 | 0.5 | provided as is with all (?:faults|risk)
as is | this software is provided | as-is-disclaimer | 30 | 0.5 | this software is provided by (?:\w+ ){1,8}as is
merchantability | merchantability | warranty-disclaimer | 25 | 0.45 | implied warrant(?:y|ies) of merchantability
in no event | in no event shall | liability-disclaimer | 25 | 0.45 | in no event shall (?:\w+ ){1,8}be liable
all rights reserved | all rights reserved | all-rights-reserved | 20 | 0.6 | all rights reserved
copyright | copyright | copyright-notice | 10 | 0.5 | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright | copyright holder | copyright-notice | 12 | 0.45 | copyright holders? and contributors
"""


def signatures() -> list[Signature]:
    rows = [x.split(" | ", 5) for x in RULES.strip("\n").splitlines() if x and not x.startswith("#")]
    return [Signature(g, k, label, int(p), float(c), pattern) for g, k, label, p, c, pattern in rows]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column, Callable[[Column, Column], Column]], Column]) -> Column:
    """The outputs array<kind> of step(state, item, give), which gives a state and outputs, over the items in order.

    It goes in strides, so that no long array is copied item by item.
    """
    none, lists = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def inner(chunk: Column, begin: Column) -> Column:
        def merge(acc: Column, x: Column) -> Column:
            return step(acc["s"], x, lambda new, out: F.struct(new.alias("s"), F.concat(acc["o"], out.cast(f"array<{kind}>")).alias("o")))

        return F.aggregate(chunk, F.struct(begin.alias("s"), none.alias("o")), merge)

    def outer(acc: Column, chunk: Column) -> Column:
        return _let(inner(chunk, acc["s"]), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    def whole(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STRIDE).cast("int")), lambda c: F.slice(a, c * STRIDE + 1, STRIDE))
        return F.when(F.size(a) > 0, F.flatten(F.aggregate(chunks, F.struct(state.alias("s"), lists.alias("o")), outer)["o"])).otherwise(none)

    return _let(items, whole)


def _places(norm: Column, phrase: str) -> Column:
    """Starts of the phrase, as word numbers from 0: pieces between its places, told apart without consuming the shared space."""
    pieces = F.split(norm, f"(?<= )(?={phrase} )")
    spaces = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))))
    ends = _scan(spaces, F.lit(0).cast("bigint"), "bigint", lambda s, x, give: give(s + x, F.array(s + x - 1)))
    return F.slice(ends, F.lit(1), F.size(pieces) - 1)


_HIT = "struct<begin:int,end:int,priority:int,label:string,confidence:double>"


def _raw(norm: Column, rules: list[Signature]) -> Column:
    """For each rule that has hits: label, priority, confidence, and of each hit the lengths with and without what precedes it."""
    groups: dict[str, list[Column]] = {}
    for r in rules:
        pattern = f"(?s)\\G(.*?)((?<= )(?:{r.pattern})(?= ))"
        sizes = lambda k, pattern=pattern: F.transform(F.regexp_extract_all(norm, F.lit(pattern), F.lit(k)), F.length)
        found = F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), sizes(0).alias("steps"), sizes(2).alias("sizes"))
        groups.setdefault(r.gate, []).append(F.when(F.contains(norm, F.lit(r.keyword)), found))
    none = F.array().cast("array<struct<label:string,priority:int,confidence:double,steps:array<int>,sizes:array<int>>>")
    parts = [F.when(F.contains(norm, F.lit(g)), F.array(*found)).otherwise(none) for g, found in groups.items()]
    return F.filter(F.flatten(F.array(*parts)), lambda r: r.isNotNull() & (F.size(r["steps"]) > 0))


def _hits(raw: Column) -> Column:
    """All hits in order: those that begin alike the longest first, those of the same span the highest first."""

    def one(r: Column) -> Column:
        ends = _scan(r["steps"], F.lit(0), "int", lambda s, x, give: give(s + x, F.array(s + x)))
        return F.transform(F.arrays_zip(ends.alias("e"), r["sizes"].alias("n")), lambda z: F.struct((z["e"] - z["n"]).alias("begin"), (-z["e"]).alias("last"), (-r["priority"]).alias("after"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    return F.transform(F.sort_array(F.flatten(F.transform(raw, one))), lambda h: F.struct(h["begin"].alias("begin"), (-h["last"]).alias("end"), (-h["after"]).alias("priority"), h["label"].alias("label"), h["confidence"].alias("confidence")))


def _outer(hits: Column, levels: list[int]) -> Column:
    """The hits that lie in no hit that outranks them.

    In the order of _hits only an earlier hit can outrank and contain one. The
    state is, for each priority, the furthest end of the hits that begin before the
    last one, and of those that begin where it begins.
    """
    n = len(levels)
    low = F.array(*[F.lit(-1)] * n)

    def step(s: Column, h: Column, give: Callable[[Column, Column], Column]) -> Column:
        same = s["begin"] == h["begin"]
        rank = F.array_position(F.array(*[F.lit(x) for x in levels]), h["priority"]).cast("int") - 1
        now = F.struct(
            rank.alias("rank"), F.when(same, s["ends"]).otherwise(F.zip_with(s["ends"], s["here"], lambda a, b: F.greatest(a, b))).alias("ends"), F.when(same, s["here"]).otherwise(low).alias("here"),
        )

        def judged(x: Column) -> Column:
            # of its own priority a hit that begins with it must end later; a higher one may end with it
            over = lambda k: (F.get(x["ends"], k) >= h["end"]) | (F.get(x["here"], k) >= h["end"] + (k == x["rank"]).cast("int"))
            covered = F.exists(F.sequence(x["rank"], F.lit(n - 1)), over)
            here = F.transform(x["here"], lambda e, k: F.when(k == x["rank"], F.greatest(e, h["end"])).otherwise(e))
            return give(F.struct(x["ends"].alias("ends"), h["begin"].alias("begin"), here.alias("here")), F.when(covered, F.array().cast(f"array<{_HIT}>")).otherwise(F.array(h)))

        return _let(now, judged)

    return _scan(hits, F.struct(low.alias("ends"), F.lit(-1).alias("begin"), low.alias("here")), _HIT, step)


def scan(docs: DataFrame, *keep: str, rules: list[Signature] | None = None) -> DataFrame:
    """The columns of keep with n_words, n_base, first_word, last_word, base_labels, labels, score and hits (label, begin, end in the reduced text)."""
    rules = signatures() if rules is None else rules
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = docs.select(F.struct(*keep).alias("keep"), F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, " ")), F.lit(" ")).alias("norm"))
    d = d.withColumn("n_words", F.when(F.col("norm") == "  ", F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("long"))
    words = sorted({r.gate for r in rules} | {p for p, _ in BASE})
    gate = F.lit(False)
    for w in [w for w in words if not any(o != w and o in w for o in words)]:
        gate = gate | F.contains("norm", F.lit(w))
    d = d.select("keep", "n_words", F.when(gate, F.col("norm")).alias("norm"))

    none = F.array().cast("array<bigint>")
    d = d.withColumns({f"at_{label}": F.when(F.contains("norm", F.lit(f" {phrase} ")), _places(F.col("norm"), phrase)).otherwise(none) for phrase, label in BASE})
    at = F.concat(*[F.col(f"at_{label}") for _, label in BASE])
    base = F.filter(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())
    # equal priorities stand for one another: hits are compared by their level
    levels = sorted({r.priority for r in rules})
    kept = _let(_raw(F.col("norm"), rules), lambda raw: F.when(F.size(raw) > 0, _outer(_hits(raw), levels)))
    d = d.withColumns({"at": at, "base": base, "hits": F.coalesce(F.when(F.col("norm").isNotNull(), kept), F.array().cast(f"array<{_HIT}>"))})
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("hits", lambda h: h["label"]))))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["confidence"])), F.lit(0.0))
    return d.select(
        "keep.*", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.size("at") > 0, F.lit(0.8)).otherwise(F.lit(0.0))).alias("score"),
        F.transform("hits", lambda h: F.struct(h["label"].alias("label"), h["begin"].alias("begin"), h["end"].alias("end"))).alias("hits"),
    )
