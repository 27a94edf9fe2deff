"""Signature rules of ``license_scan``: label, kind, keywords and pattern, written by hand, in order of precedence.

Patterns are matched against the words of a text in lower case, one blank between two: "GPL-2.0+" reads "gpl 2 0". A pattern matches whole
words. All keywords of a rule must stand in the text, each at the start of a word, before its pattern is tried.

Kinds, from strong to weak: tag (machine-readable identifier), text (a sentence of the license itself), notice (a grant that names the
license), url, title (the license's full name), name (a short form that other texts may use too).
"""

from __future__ import annotations

#: kind -> (priority, confidence)
KINDS = {"tag": (4, 1.0), "text": (4, 0.95), "notice": (3, 0.9), "url": (3, 0.85), "title": (2, 0.75), "name": (1, 0.5)}

#: what starts a grant; each title below also makes a notice rule with it in front
GRANT = "(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistributed|shared|dual licen[cs]ed|made available|offered|issued)(?: to you)? (?:under|subject to|according to|with)"
TERMS = "(?: the| a| an)?(?: terms(?: and conditions)?(?: of)?| conditions(?: of)?| provisions of)?(?: the| a| an)?(?: open source| free software| permissive)?"

#: the three base phrases; their places stand in every result
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: every rule's text holds one of these, at the start of a word
STEMS = ["licen", "unlicen", "sublicen", "copyright", "copyleft", "spdx", "public domain", "creative", "creativecommons", "cc ", "cc0", "gpl", "lgpl", "agpl", "gnu", "permission",
         "redistribution", "software is", "wtfpl", "opensource", "apache", "mozilla", "boost", "bsd", "all rights", "warranty", "asl", "mpl", "eupl", "ofl", "0bsd", "gfdl", "commons",
         "neither the name", "proprietary", "reproduced", "same terms", "plainly marked", "unencumbered", "remotely", "advertising materials", "attribution", "eclipse", "scripts sil",
         "openssl project"]

SIGNATURES = """
mit | text | permission granted deal | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit | text | copyright portions | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | text | software provided kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | title | mit licen | (?:expat )?mit(?: expat| x11| style| open source)? licen[cs]e
mit | url | opensource mit | opensource org licen[cs]es? mit(?: license)?(?: php| html)?
mit | name | x11 licen | x11 licen[cs]e
mit | name | expat licen | expat licen[cs]e
mit-0 | title | mit attribution | mit no attribution(?: licen[cs]e)?
mit-0 | title | mit 0 | mit 0 licen[cs]e
apache-2 | text | compliance obtain | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 | title | apache licen | apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 | title | apache licen | apache 2(?: 0)?(?: open source| software)? licen[cs]e
apache-2 | url | apache licen | apache org licen[cs]es licen[cs]e 2 0(?: html| txt)?
apache-2 | url | opensource apache | opensource org licen[cs]es apache 2 0(?: php)?
apache-2 | name | asl | asl 2 0
apache-1.1 | title | apache licen | apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache-1.0 | title | apache licen | apache(?: software)? licen[cs]e(?: version| v)? ?1 0
apache | name | apache licen | apache(?: software)? licen[cs]e
agpl-3 | title | affero public | (?:gnu )?affero general public licen[cs]e(?: agpl)? (?:version |v )?v?3(?: 0)?
agpl-3 | text | network remotely | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3 | url | gnu agpl | gnu org licen[cs]es agpl(?: 3 0)?(?: html| txt| en html)?
agpl-3 | name | agpl | agpl ?v? ?3(?: 0)?(?: or later| only)?
agpl-3 | name | agplv3 | agplv3(?: or later)?
agpl | title | affero | (?:gnu )?affero general public licen[cs]e
agpl | name | agpl licen | agpl licen[cs]e
lgpl-3 | title | lesser general public | (?:gnu )?lesser general public licen[cs]e(?: lgpl)? (?:version |v )?v?3(?: 0)?
lgpl-3 | url | gnu lgpl | gnu org licen[cs]es lgpl 3 0(?: html| txt| en html)?
lgpl-3 | name | lgpl | lgpl ?v? ?3(?: 0)?(?: or later| only)?
lgpl-3 | name | lgplv3 | lgplv3
lgpl-2.1 | title | lesser general public | (?:gnu )?lesser general public licen[cs]e(?: lgpl)? (?:version |v )?v?2 1
lgpl-2.1 | url | gnu lgpl | gnu org licen[cs]es(?: old licen[cs]es)? lgpl 2 1(?: html| txt| en html)?
lgpl-2.1 | name | lgpl | lgpl ?v? ?2 1(?: or later| only)?
lgpl-2.1 | text | library lesser redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl-2.0 | title | library general | (?:gnu )?library general public licen[cs]e(?: lgpl)?(?: (?:version |v )?v?2(?: 0)?)?
lgpl | title | lesser general | (?:gnu )?lesser general public licen[cs]e
lgpl | name | lgpl licen | lgpl licen[cs]e
gpl-3 | title | general public | (?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation(?: either)?)? (?:version |v )?v?3(?: 0)?
gpl-3 | url | gnu gpl | gnu org licen[cs]es gpl 3 0(?: html| txt| en html)?
gpl-3 | name | gpl | gpl ?v? ?3(?: 0)?(?: or later| only)?
gpl-3 | name | gplv3 | gplv3(?: or later)?
gpl-2 | title | general public | (?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation(?: either)?)? (?:version |v )?v?2(?: 0)?
gpl-2 | url | gnu gpl | gnu org licen[cs]es(?: old licen[cs]es)? gpl 2 0(?: html| txt| en html)?
gpl-2 | name | gpl | gpl ?v? ?2(?: 0)?(?: or later| only)?
gpl-2 | name | gplv2 | gplv2(?: or later)?
gpl-1 | title | general public | (?:gnu )?general public licen[cs]e(?: gpl)? (?:version |v )?v?1(?: 0)?
gpl | text | program redistribute foundation | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl | text | program hope useful | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl | text | received general | you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library)
gpl | title | gnu general | gnu general public licen[cs]e
gpl | url | gnu org gpl | gnu org (?:licen[cs]es|copyleft) gpl(?: html| txt)?
gpl | name | gpl licen | gpl licen[cs]e
gpl | name | gnu gpl | gnu gpl
gfdl-1.3 | title | gnu documentation | gnu free documentation licen[cs]e(?: gfdl)? (?:version |v )?v?1 3
gfdl-1.2 | title | gnu documentation | gnu free documentation licen[cs]e(?: gfdl)? (?:version |v )?v?1 2
gfdl | title | gnu documentation | gnu free documentation licen[cs]e
gfdl | url | gnu fdl | gnu org licen[cs]es fdl(?: 1 [123])?(?: html| txt)?
gfdl | name | gfdl | gfdl(?: 1 [123])?
bsd-4-clause | text | advertising materials acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | title | bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
bsd-3-clause | text | endorse promote | neither the name of (?:the )?[^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause | title | bsd clause | (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: new| revised)?(?: licen[cs]e)?
bsd-3-clause | title | bsd licen | (?:new|modified|revised) bsd(?: style)? licen[cs]e
bsd-3-clause | url | opensource bsd | opensource org licen[cs]es bsd 3 clause
bsd-2-clause | title | bsd clause | (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: simplified)?(?: licen[cs]e)?
bsd-2-clause | title | bsd licen | (?:simplified|freebsd) bsd licen[cs]e
bsd-2-clause | title | freebsd licen | freebsd licen[cs]e
bsd-2-clause | url | opensource bsd | opensource org licen[cs]es bsd 2 clause
bsd-1-clause | title | bsd clause | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
bsd-0-clause | title | bsd clause | (?:bsd zero clause|zero clause bsd|0 clause bsd|bsd 0 clause)(?: licen[cs]e)?
bsd-0-clause | name | 0bsd | 0bsd
bsd | text | redistribution binary permitted | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | text | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | title | bsd licen | bsd(?: style| type)? licen[cs]e
bsd | url | opensource bsd | opensource org licen[cs]es bsd licen[cs]e(?: php| html)?
isc | text | permission isc hereby copies | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies isc
isc | title | isc licen | isc licen[cs]e
isc | text | permission distribute fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
mpl-2 | text | mozilla subject source | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | title | mozilla public | mozilla public licen[cs]e(?: mpl)? (?:version |v )?v?2(?: 0)?
mpl-2 | url | mozilla mpl | mozilla org (?:en us )?mpl 2 0
mpl-2 | name | mpl | mpl ?v? ?2 0
mpl-1.1 | title | mozilla public | mozilla public licen[cs]e(?: mpl)? (?:version |v )?v?1 1
mpl-1.1 | url | mozilla mpl | mozilla org mpl(?: mpl)? 1 1(?: html)?
mpl-1.0 | title | mozilla public | mozilla public licen[cs]e(?: mpl)? (?:version |v )?v?1 0
mpl | title | mozilla public | mozilla public licen[cs]e
epl-2 | title | eclipse public | eclipse public licen[cs]e(?: epl)? (?:version |v )?v?2 0
epl-2 | url | eclipse legal | eclipse org legal epl ?(?:v20|2 0)(?: html)?
epl-1 | title | eclipse public | eclipse public licen[cs]e(?: epl)? (?:version |v )?v?1 0
epl-1 | url | eclipse legal | eclipse org legal epl v10(?: html)?
epl | title | eclipse public | eclipse public licen[cs]e
edl-1 | title | eclipse distribution | eclipse distribution licen[cs]e(?: (?:version |v )?v?1 0)?
cddl-1.1 | title | common development distribution | common development and distribution licen[cs]e(?: cddl)? (?:version |v )?v?1 1
cddl-1.0 | title | common development distribution | common development and distribution licen[cs]e(?: cddl)? (?:version |v )?v?1 0
cddl | title | common development distribution | common development and distribution licen[cs]e
cpl-1 | title | common public | common public licen[cs]e(?: (?:version |v )?v?1 0)?
ipl-1 | title | ibm public | ibm public licen[cs]e(?: (?:version |v )?v?1 0)?
eupl-1.2 | title | european union public | european union public licen[cs]e(?: eupl)? (?:version |v )?v?1 2
eupl-1.1 | title | european union public | european union public licen[cs]e(?: eupl)? (?:version |v )?v?1 1
eupl | title | european union public | european union public licen[cs]e
eupl | name | eupl | eupl(?: ?v? ?1 [012])?
osl-3 | title | open software | open software licen[cs]e(?: (?:version |v )?v?3 0)?
afl-3 | title | academic free | academic free licen[cs]e(?: (?:version |v )?v?[123] [0-9])?
artistic-2 | title | artistic licen | artistic licen[cs]e(?: version)? 2(?: 0)?
artistic-2 | url | opensource artistic | opensource org licen[cs]es artistic licen[cs]e 2 0
artistic-1 | title | artistic licen | artistic licen[cs]e(?: version)? 1(?: 0)?
artistic | title | artistic licen | artistic licen[cs]e
perl | notice | same terms perl | under the same terms as perl(?: [56])?(?: itself)?
psf-2 | title | python software foundation | python software foundation licen[cs]e(?: version 2)?
psf-2 | name | psf licen | psf licen[cs]e(?: agreement)?(?: version 2)?
python-2 | title | python licen | python licen[cs]e(?: 2 0)?
ruby | title | ruby licen | ruby licen[cs]e
ruby | notice | same terms ruby | under the same terms as ruby(?: itself)?
php-3 | title | php licen | php licen[cs]e(?: version)? 3(?: 0 ?1?)?
php | title | php licen | php licen[cs]e
zlib | text | altered plainly misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | title | zlib licen | zlib(?: libpng)? licen[cs]e
libpng | title | libpng licen | libpng licen[cs]e(?: version 2)?
bsl-1 | text | permission organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1 | title | boost software | boost software licen[cs]e(?: version)?(?: 1 0)?
bsl-1 | url | boost licen | boost org licen[cs]e 1 0 txt
unlicense | text | unencumbered public domain | this is free and unencumbered software released into the public domain
unlicense | title | unlicense | (?:the )?unlicense
unlicense | url | unlicense org | unlicense org(?: unlicense)?
wtfpl | title | fuck public | do what the fuck you want to public licen[cs]e(?: version 2)?
wtfpl | name | wtfpl | wtfpl(?: ?v? ?2)?
cc0-1 | title | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1 | title | creative commons | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: licen[cs]e)?
cc0-1 | url | creativecommons publicdomain | creativecommons org publicdomain zero 1 0
public-domain | notice | public domain | (?:released|placed|dedicated|donated|put|is)(?: in)?(?: in)?(?:to)? the public domain
public-domain | url | creativecommons publicdomain | creativecommons org publicdomain mark 1 0
public-domain | name | public domain | public domain
cc-by-nc-nd | title | attribution non | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative|ative work|ative works|atives|s)(?: (?:[1-4] 0))?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd | url | creativecommons by nc nd | creativecommons org licen[cs]es by nc nd(?: [1-4] [05])?
cc-by-nc-nd | name | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | title | attribution share | (?:creative commons )?attribution non ?commercial share ?alike(?: (?:[1-4] 0))?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa | url | creativecommons by nc sa | creativecommons org licen[cs]es by nc sa(?: [1-4] [05])?
cc-by-nc-sa | name | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc | title | creative attribution | creative commons attribution non ?commercial(?: (?:[1-4] 0))?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc | url | creativecommons by nc | creativecommons org licen[cs]es by nc(?: [1-4] [05])?
cc-by-nd | title | creative attribution | creative commons attribution no ?deriv(?:ative|ative work|ative works|atives|s)(?: (?:[1-4] 0))?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd | url | creativecommons by nd | creativecommons org licen[cs]es by nd(?: [1-4] [05])?
cc-by-nd | name | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-sa | title | creative attribution share | creative commons attribution share ?alike(?: (?:[1-4] 0))?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa | url | creativecommons by sa | creativecommons org licen[cs]es by sa(?: [1-4] [05])?
cc-by-sa | name | cc by sa | cc by sa(?: [1-4] [05])?
cc-by | title | creative attribution | creative commons attribution(?: (?:[1-4] 0))?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by | url | creativecommons by | creativecommons org licen[cs]es by [1-4] [05]
cc-by | name | cc by | cc by(?: [1-4] [05])?
creative-commons | title | creative commons licen | creative commons(?: public)? licen[cs]e
ofl-1.1 | title | open font | (?:sil )?open font licen[cs]e(?: ofl)?(?: version)?(?: 1 1)?
ofl-1.1 | url | sil ofl | scripts sil org ofl
ofl-1.1 | name | ofl | ofl 1 1
odbl-1 | title | open database | open (?:data commons open )?database licen[cs]e(?: odbl)?(?: v?1 0)?
odc-by-1 | title | open data attribution | open data commons attribution licen[cs]e
pddl-1 | title | public dedication licen | (?:open data commons )?public domain dedication and licen[cs]e
cdla | title | community data licen | community data licen[cs]e agreement(?: (?:permissive|sharing))?(?: (?:version )?[12] 0)?
ms-pl | title | microsoft public | microsoft public licen[cs]e(?: ms pl)?
ms-rl | title | microsoft reciprocal | microsoft reciprocal licen[cs]e(?: ms rl)?
qpl-1 | title | q public | q public licen[cs]e(?: (?:version )?1 0)?
sleepycat | title | sleepycat | sleepycat(?: public)? licen[cs]e
openssl | title | openssl licen | openssl licen[cs]e
openssl | text | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
w3c | title | w3c licen | w3c software(?: notice)?(?: and)? licen[cs]e
ncsa | title | ncsa open | (?:university of illinois )?ncsa open source licen[cs]e
unicode | title | unicode licen | unicode(?: data files and software| license agreement)? licen[cs]e(?: v3)?
upl-1 | title | universal permissive | universal permissive licen[cs]e(?: (?:version )?1 0)?
vim | title | vim licen | vim licen[cs]e
tcl | title | tcl licen | tcl(?: tk)? licen[cs]e
postgresql | title | postgresql licen | postgresql licen[cs]e
ijg | title | jpeg group licen | independent jpeg group licen[cs]e
beerware | title | beer | beer ?ware licen[cs]e
sspl-1 | title | server side public | server side public licen[cs]e(?: (?:version )?v?1)?
busl-1.1 | title | business source | business source licen[cs]e(?: (?:version )?1 1)?
elastic-2 | title | elastic licen | elastic licen[cs]e(?: (?:version )?v?2(?: 0)?)?
commons-clause | title | commons clause | commons clause(?: licen[cs]e)?(?: condition)?
openrail | title | open licen | (?:creativeml )?open ?rail(?: ?m)? licen[cs]e
proprietary | text | confidential proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | notice | rights reserved | all rights reserved
proprietary | notice | reproduced without permission | (?:may not be|no part (?:of )?(?:this )?[^ ]+(?: [^ ]+){0,3} may be) reproduced(?: [^ ]+){0,8} without(?: the)? (?:express |prior )*(?:written )?permission
"""

#: identifiers that make tag rules ("SPDX-License-Identifier: ..."): label, then the identifier's words
TAGS = """
bsd-0-clause:0bsd mit-0:mit_0 mit apache-2:apache_2_0 apache-1.1:apache_1_1 apache-1.0:apache_1_0 agpl-3:agpl_3_0 lgpl-3:lgpl_3_0 lgpl-2.1:lgpl_2_1 lgpl-2.0:lgpl_2_0
gpl-3:gpl_3_0 gpl-2:gpl_2_0 gpl-1:gpl_1_0 gfdl-1.3:gfdl_1_3 gfdl-1.2:gfdl_1_2 bsd-4-clause:bsd_4_clause bsd-3-clause:bsd_3_clause bsd-2-clause:bsd_2_clause
bsd-1-clause:bsd_1_clause isc mpl-2:mpl_2_0 mpl-1.1:mpl_1_1 epl-2:epl_2_0 epl-1:epl_1_0 cddl-1.1:cddl_1_1 cddl-1.0:cddl_1_0 eupl-1.2:eupl_1_2 eupl-1.1:eupl_1_1 osl-3:osl_3_0
afl-3:afl_3_0 artistic-2:artistic_2_0 artistic-1:artistic_1_0 psf-2:psf_2_0 python-2:python_2_0 ruby php-3:php_3_01 zlib libpng:libpng_2_0 bsl-1:bsl_1_0 unlicense wtfpl
cc0-1:cc0_1_0 cc-by-nc-nd:cc_by_nc_nd_[1-4]_[05] cc-by-nc-sa:cc_by_nc_sa_[1-4]_[05] cc-by-nc:cc_by_nc_[1-4]_[05] cc-by-nd:cc_by_nd_[1-4]_[05] cc-by-sa:cc_by_sa_[1-4]_[05]
cc-by:cc_by_[1-4]_[05] ofl-1.1:ofl_1_1 odbl-1:odbl_1_0 odc-by-1:odc_by_1_0 pddl-1:pddl_1_0 ms-pl:ms_pl ms-rl:ms_rl ncsa upl-1:upl_1_0 postgresql vim sspl-1:sspl_1_0 busl-1.1:busl_1_1
elastic-2:elastic_2_0
"""
