"""Signature rules for licenses, most specific first: the order is the priority.

A rule is a label, a confidence, a keyword, and a regex over words: texts are lower-cased, and all that is not a
letter or digit separates words, so ``GPL-3.0`` reads ``gpl 3 0``. A space in a regex stands for a word
boundary. ``{name}`` is one of the parts below. Every match holds the keyword, or one of several, as a word of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

PARTS = {
    "lic": "licen[cs]es?",
    "under": "(?:under|subject to|governed by|covered by)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the| a| an)?",
    "later": "(?: or| and)?(?: at your option)?(?: any)? later(?: versions?)?",
    "v1": "(?:v|version |v )?1(?: 0)?",
    "v11": "(?:v|version |v )?1 1",
    "v12": "(?:v|version |v )?1 2",
    "v13": "(?:v|version |v )?1 3",
    "v2": "(?:v|version |v )?2(?: 0)?",
    "v21": "(?:v|version |v )?2 1",
    "v3": "(?:v|version |v )?3(?: 0)?",
    "cc": "(?:cc|creative commons)",
    "by": "(?:by|attribution)",
    "nc": "(?:nc|noncommercial|non commercial)",
    "nd": "(?:nd|noderiv(?:ative)?s?|no deriv(?:ative)?s?(?: works?)?)",
    "sa": "(?:sa|sharealike|share alike)",
    "spdx": "spdx licen[cs]e identifier",
}

RULES_TEXT = """
# Machine-readable identifiers
mit | 1.0 | spdx | {spdx} mit
mit-0 | 1.0 | spdx | {spdx} mit 0
apache-2.0 | 1.0 | spdx | {spdx} apache 2 0
apache-1.1 | 1.0 | spdx | {spdx} apache 1 1
gpl-2.0-only | 1.0 | spdx | {spdx} gpl 2 0(?: only)?
gpl-2.0-or-later | 1.0 | spdx | {spdx} gpl 2 0 or later
gpl-3.0-only | 1.0 | spdx | {spdx} gpl 3 0(?: only)?
gpl-3.0-or-later | 1.0 | spdx | {spdx} gpl 3 0 or later
lgpl-2.1-only | 1.0 | spdx | {spdx} lgpl 2 1(?: only)?
lgpl-2.1-or-later | 1.0 | spdx | {spdx} lgpl 2 1 or later
lgpl-3.0-only | 1.0 | spdx | {spdx} lgpl 3 0(?: only)?
lgpl-3.0-or-later | 1.0 | spdx | {spdx} lgpl 3 0 or later
agpl-3.0-only | 1.0 | spdx | {spdx} agpl 3 0(?: only)?
agpl-3.0-or-later | 1.0 | spdx | {spdx} agpl 3 0 or later
bsd-2-clause | 1.0 | spdx | {spdx} bsd 2 clause
bsd-3-clause | 1.0 | spdx | {spdx} bsd 3 clause
bsd-4-clause | 1.0 | spdx | {spdx} bsd 4 clause
0bsd | 1.0 | spdx | {spdx} 0bsd
isc | 1.0 | spdx | {spdx} isc
mpl-1.1 | 1.0 | spdx | {spdx} mpl 1 1
mpl-2.0 | 1.0 | spdx | {spdx} mpl 2 0
epl-1.0 | 1.0 | spdx | {spdx} epl 1 0
epl-2.0 | 1.0 | spdx | {spdx} epl 2 0
cddl-1.0 | 1.0 | spdx | {spdx} cddl 1 0
bsl-1.0 | 1.0 | spdx | {spdx} bsl 1 0
unlicense | 1.0 | spdx | {spdx} unlicense
zlib | 1.0 | spdx | {spdx} zlib
cc0-1.0 | 1.0 | spdx | {spdx} cc0 1 0
cc-by-4.0 | 1.0 | spdx | {spdx} cc by 4 0
cc-by-sa-4.0 | 1.0 | spdx | {spdx} cc by sa 4 0
cc-by-nc-4.0 | 1.0 | spdx | {spdx} cc by nc 4 0
wtfpl | 1.0 | spdx | {spdx} wtfpl
unknown-spdx | 0.6 | spdx | {spdx} [a-z0-9]+
# Notices of the general public licenses
gpl-2.0-or-later | 1.0 | gnu | redistribute it and or modify it under the terms of the gnu general public {lic} as published by the free software foundation either version 2 of the {lic} or at your option any later version
gpl-3.0-or-later | 1.0 | gnu | redistribute it and or modify it under the terms of the gnu general public {lic} as published by the free software foundation either version 3 of the {lic} or at your option any later version
gpl-2.0-only | 1.0 | gnu | redistribute it and or modify it under the terms of the gnu general public {lic} version 2(?: only)? as published by the free software foundation
lgpl-2.1-or-later | 1.0 | gnu | redistribute it and or modify it under the terms of the gnu lesser general public {lic} as published by the free software foundation either version 2 1 of the {lic} or at your option any later version
lgpl-3.0-or-later | 1.0 | gnu | redistribute it and or modify it under the terms of the gnu lesser general public {lic} as published by the free software foundation either version 3 of the {lic} or at your option any later version
lgpl-2.0-or-later | 1.0 | gnu | redistribute it and or modify it under the terms of the gnu library general public {lic} as published by the free software foundation either version 2 of the {lic} or at your option any later version
agpl-3.0-or-later | 1.0 | gnu | redistribute it and or modify it under the terms of the gnu affero general public {lic} as published by the free software foundation either version 3 of the {lic} or at your option any later version
agpl-3.0-or-later | 0.95 | affero | (?:gnu )?affero general public {lic} {v3}{later}
agpl-3.0 | 0.95 | affero | (?:gnu )?affero general public {lic} {v3}
agpl-1.0 | 0.95 | affero | affero general public {lic} {v1}
agpl | 0.8 | affero | (?:gnu )?affero general public {lic}
agpl-3.0-or-later | 0.9 | agpl | (?:gnu )?agpl {v3}{later}
agpl-3.0 | 0.9 | agpl | (?:gnu )?agpl {v3}
agpl-3.0 | 0.9 | agplv3 | (?:gnu )?agplv3
lgpl-2.1-or-later | 0.95 | lesser | gnu lesser general public {lic} {v21}{later}
lgpl-3.0-or-later | 0.95 | lesser | gnu lesser general public {lic} {v3}{later}
lgpl-2.1 | 0.95 | lesser | gnu lesser general public {lic} {v21}
lgpl-3.0 | 0.95 | lesser | gnu lesser general public {lic} {v3}
lgpl-2.0 | 0.95 | gnu | gnu library general public {lic} {v2}
lgpl | 0.8 | lesser | (?:gnu )?lesser general public {lic}
lgpl | 0.8 | gnu | gnu library general public {lic}
lgpl-2.1-or-later | 0.9 | lgpl | (?:gnu )?lgpl {v21}{later}
lgpl-3.0-or-later | 0.9 | lgpl | (?:gnu )?lgpl {v3}{later}
lgpl-2.1 | 0.9 | lgpl | (?:gnu )?lgpl {v21}
lgpl-3.0 | 0.9 | lgpl | (?:gnu )?lgpl {v3}
lgpl-2.1 | 0.9 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
lgpl-3.0 | 0.9 | lgplv3 | (?:gnu )?lgplv3
gpl-1.0-or-later | 0.95 | gnu | gnu general public {lic} {v1}{later}
gpl-2.0-or-later | 0.95 | gnu | gnu general public {lic} {v2}{later}
gpl-3.0-or-later | 0.95 | gnu | gnu general public {lic} {v3}{later}
gpl-2.0-classpath | 0.95 | classpath | gnu general public {lic} {v2}(?: only)? with(?: the)? classpath exception
gpl-2.0-only | 0.95 | gnu | gnu general public {lic} {v2} only
gpl-3.0-only | 0.95 | gnu | gnu general public {lic} {v3} only
gpl-1.0 | 0.95 | gnu | gnu general public {lic} {v1}
gpl-2.0 | 0.95 | gnu | gnu general public {lic} {v2}
gpl-3.0 | 0.95 | gnu | gnu general public {lic} {v3}
gpl-2.0-or-later | 0.9 | gpl | (?:gnu )?gpl {v2}{later}
gpl-3.0-or-later | 0.9 | gpl | (?:gnu )?gpl {v3}{later}
gpl-2.0-only | 0.9 | gpl | (?:gnu )?gpl {v2} only
gpl-3.0-only | 0.9 | gpl | (?:gnu )?gpl {v3} only
gpl-1.0 | 0.9 | gpl | (?:gnu )?gpl {v1}
gpl-2.0 | 0.9 | gpl | (?:gnu )?gpl {v2}
gpl-3.0 | 0.9 | gpl | (?:gnu )?gpl {v3}
gpl-2.0 | 0.9 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | 0.9 | gplv3 | (?:gnu )?gplv3
gfdl-1.1 | 0.95 | gnu | gnu free documentation {lic} {v11}
gfdl-1.2 | 0.95 | gnu | gnu free documentation {lic} {v12}
gfdl-1.3 | 0.95 | gnu | gnu free documentation {lic} {v13}
gfdl | 0.8 | gnu | gnu free documentation {lic}
gfdl-1.3 | 0.9 | gfdl | gfdl {v13}
gfdl | 0.7 | gfdl | (?:gnu )?gfdl
gpl-3.0 | 0.9 | gnu | gnu org licenses gpl 3 0
gpl-2.0 | 0.9 | gnu | gnu org licenses (?:old licenses )?gpl 2 0
lgpl-2.1 | 0.9 | gnu | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | 0.9 | gnu | gnu org licenses lgpl 3 0
agpl-3.0 | 0.9 | gnu | gnu org licenses agpl 3 0
gfdl | 0.8 | gnu | gnu org licenses fdl
# Creative Commons
cc-by-nc-nd-4.0 | 0.95 | cc/commons | {cc} {by} {nc} {nd} 4(?: 0)?(?: international)?(?: {lic})?
cc-by-nc-nd-3.0 | 0.95 | cc/commons | {cc} {by} {nc} {nd} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-nc-nd-2.0 | 0.95 | cc/commons | {cc} {by} {nc} {nd} 2 [05](?: generic)?(?: {lic})?
cc-by-nc-sa-4.0 | 0.95 | cc/commons | {cc} {by} {nc} {sa} 4(?: 0)?(?: international)?(?: {lic})?
cc-by-nc-sa-3.0 | 0.95 | cc/commons | {cc} {by} {nc} {sa} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-nc-sa-2.0 | 0.95 | cc/commons | {cc} {by} {nc} {sa} 2 [05](?: generic)?(?: {lic})?
cc-by-nc-4.0 | 0.95 | cc | cc by {nc} 4(?: 0)?(?: international)?(?: {lic})?
cc-by-nc-3.0 | 0.95 | cc | cc by {nc} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-nc-2.0 | 0.95 | cc | cc by {nc} 2 [05](?: generic)?(?: {lic})?
cc-by-nc-4.0 | 0.95 | commons | creative commons {by} {nc} 4(?: 0)?(?: international)?(?: {lic})?
cc-by-nc-3.0 | 0.95 | commons | creative commons {by} {nc} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-nd-4.0 | 0.95 | cc/commons | {cc} {by} {nd} 4(?: 0)?(?: international)?(?: {lic})?
cc-by-nd-3.0 | 0.95 | cc/commons | {cc} {by} {nd} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-sa-4.0 | 0.95 | cc | cc by {sa} 4(?: 0)?(?: international)?(?: {lic})?
cc-by-sa-3.0 | 0.95 | cc | cc by {sa} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-sa-2.0 | 0.95 | cc | cc by {sa} 2 [05](?: generic)?(?: {lic})?
cc-by-sa-4.0 | 0.95 | commons | creative commons {by} {sa} 4(?: 0)?(?: international)?(?: {lic})?
cc-by-sa-3.0 | 0.95 | commons | creative commons {by} {sa} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-sa-2.0 | 0.95 | commons | creative commons {by} {sa} 2 [05](?: generic)?(?: {lic})?
cc-by-4.0 | 0.95 | cc | cc by 4(?: 0)?(?: international)?(?: {lic})?
cc-by-3.0 | 0.95 | cc | cc by 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-2.0 | 0.95 | cc | cc by 2 [05](?: generic)?(?: {lic})?
cc-by-4.0 | 0.95 | commons | creative commons {by} 4(?: 0)?(?: international)?(?: public)?(?: {lic})?
cc-by-3.0 | 0.95 | commons | creative commons {by} 3(?: 0)?(?: unported)?(?: {lic})?
cc-by-2.0 | 0.95 | commons | creative commons {by} 2 [05](?: generic)?(?: {lic})?
cc-by-nc-nd | 0.8 | commons | creative commons {by} {nc} {nd}(?: {lic})?
cc-by-nc-sa | 0.8 | commons | creative commons {by} {nc} {sa}(?: {lic})?
cc-by-nc | 0.8 | commons | creative commons {by} {nc}(?: {lic})?
cc-by-nd | 0.8 | commons | creative commons {by} {nd}(?: {lic})?
cc-by-sa | 0.8 | commons | creative commons {by} {sa}(?: {lic})?
cc-by-nc-nd | 0.8 | cc | cc by nc nd
cc-by-nc-sa | 0.8 | cc | cc by nc sa
cc-by-nc | 0.8 | cc | cc by {nc}
cc-by-nd | 0.8 | cc | cc by {nd}
cc-by-sa | 0.8 | cc | cc by {sa}
cc0-1.0 | 0.95 | cc0 | cc0 {v1}(?: universal)?(?: public domain dedication)?
cc0-1.0 | 0.95 | commons | creative commons zero(?: {v1})?(?: universal)?
cc0-1.0 | 0.8 | cc0 | cc0
cc-pdm-1.0 | 0.9 | domain | public domain mark {v1}
cc-by-nc-nd | 0.9 | creativecommons | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.9 | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | 0.9 | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 0.9 | creativecommons | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa | 0.9 | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by | 0.9 | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
cc0-1.0 | 0.95 | creativecommons | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | 0.95 | creativecommons | creativecommons org publicdomain mark 1 0
cc | 0.5 | commons | {under} creative commons(?: {lic})?
# Apache, MIT, BSD and others that ask little
apache-2.0 | 1.0 | apache | licensed under the apache {lic} version 2 0(?: the {lic})?(?: you may not use this file except in compliance with the {lic})?
apache-2.0 | 0.95 | apache | apache(?: software)? {lic} {v2}
apache-1.1 | 0.95 | apache | apache(?: software)? {lic} {v11}
apache-1.0 | 0.95 | apache | apache(?: software)? {lic} {v1}
apache-2.0 | 0.95 | apache | apache org licenses license 2 0
apache-1.1 | 0.9 | apache | apache org licenses license 1 1
apache-2.0 | 0.9 | apache | apache {v2}
apache-2.0 | 0.9 | asl | asl 2 0
apache-2.0-llvm | 0.95 | llvm | apache {lic} {v2} with llvm exceptions?
apache | 0.7 | apache | apache software {lic}
mit | 1.0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit-0 | 0.95 | attribution | mit no attribution(?: {lic})?
mit-modern | 0.9 | variant | mit {lic} modern variant
mit | 0.95 | {lic} | (?:released|licensed|distributed|available|published|provided) under(?: the)?(?: terms of the)? mit {lic}
mit | 0.9 | expat | expat {lic}
mit | 0.9 | opensource | opensource org licenses mit(?: license)?
x11 | 0.9 | x11 | x11 {lic}
bsd-4-clause | 0.95 | bsd | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: {lic})?
bsd-3-clause | 0.95 | bsd | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: {lic})?
bsd-2-clause | 0.95 | bsd/freebsd | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: {lic})?
0bsd | 0.95 | bsd | (?:zero clause bsd|bsd zero clause|0 clause bsd)(?: {lic})?
0bsd | 0.9 | 0bsd | 0bsd
bsd-3-clause | 1.0 | endorse | neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd | 1.0 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-4-clause | 0.9 | advertising | all advertising materials mentioning features or use of this software must display
bsd | 0.8 | {lic} | (?:berkeley software distribution|bsd) (?:style )?{lic}
isc | 1.0 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | isc | isc {lic}
zlib | 0.95 | zlib | zlib(?: libpng)? {lic}
zlib | 0.9 | altered | altered source versions must be plainly marked as such
libpng | 0.9 | libpng | libpng {lic}
bsl-1.0 | 0.95 | {lic} | boost software {lic}(?: {v1})?
bsl-1.0 | 0.9 | boost | boost org license 1 0
unlicense | 1.0 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 0.9 | unlicense | (?:the )?unlicense
wtfpl | 0.95 | {lic} | do what the [^ ]+ you want to public {lic}(?: {v2})?
wtfpl | 0.9 | wtfpl | wtfpl
postgresql | 0.9 | postgresql | postgresql {lic}
python-2.0 | 0.9 | {lic} | (?:python software foundation|psf|python) {lic}(?: {v2})?
ruby | 0.9 | {lic} | ruby {lic}
php-3.0 | 0.9 | {lic} | php {lic}(?: {v3})?
php-3.01 | 0.95 | {lic} | php {lic} (?:v|version |v )?3 01
perl | 0.9 | perl | same terms as perl(?: itself)?
artistic-1.0 | 0.95 | artistic | artistic {lic} {v1}
artistic-2.0 | 0.95 | artistic | artistic {lic} {v2}
artistic | 0.8 | artistic | artistic {lic}
ncsa | 0.9 | ncsa | (?:university of illinois )?ncsa(?: open source)? {lic}
ncsa | 0.9 | illinois | university of illinois open source {lic}
afl-3.0 | 0.95 | academic | academic free {lic} {v3}
afl-2.1 | 0.95 | academic | academic free {lic} {v21}
afl | 0.8 | academic | academic free {lic}
ecl-2.0 | 0.9 | educational | educational community {lic}(?: {v2})?
upl-1.0 | 0.9 | permissive | universal permissive {lic}(?: {v1})?
blueoak-1.0.0 | 0.9 | oak | blue oak model {lic}(?: 1 0 0)?
openssl | 0.9 | openssl | openssl(?: ssleay)? {lic}
curl | 0.9 | {lic} | curl {lic}
vim | 0.9 | {lic} | vim {lic}
ijg | 0.9 | jpeg | independent jpeg group {lic}
ftl | 0.9 | freetype | freetype(?: project)? {lic}
unicode | 0.9 | {lic} | unicode(?: data files and software| inc)? {lic}(?: agreement)?
w3c | 0.9 | w3c | w3c software(?: notice)?(?: and)?(?: document)? {lic}
hpnd | 0.9 | disclaimer | historical permission notice and disclaimer
naist | 0.8 | naist | naist {lic}
beerware | 0.9 | {lic} | (?:the )?(?:beerware|beer ware) {lic}
# Licenses that ask for changes of files to stay open
mpl-2.0-no-copyleft | 0.95 | incompatible | this source code form is incompatible with secondary {lic}
mpl-2.0 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public {lic} {v2}
mpl-2.0 | 0.95 | mozilla | mozilla public {lic} {v2}
mpl-1.1 | 0.95 | mozilla | mozilla public {lic} {v11}
mpl-1.0 | 0.95 | mozilla | mozilla public {lic} {v1}
mpl | 0.8 | mozilla | mozilla public {lic}
mpl-2.0 | 0.9 | mpl | mpl {v2}
mpl-1.1 | 0.9 | mpl | mpl {v11}
epl-2.0 | 0.95 | eclipse | eclipse public {lic} {v2}
epl-1.0 | 0.95 | eclipse | eclipse public {lic} {v1}
epl | 0.8 | eclipse | eclipse public {lic}
edl-1.0 | 0.9 | eclipse | eclipse distribution {lic}(?: {v1})?
epl-2.0 | 0.9 | epl | epl {v2}
epl-1.0 | 0.9 | epl | epl {v1}
cddl-1.1 | 0.95 | cddl | cddl {v11}
cddl-1.0 | 0.95 | cddl | cddl {v1}
cddl | 0.9 | {lic} | common development and distribution {lic}(?: {v1})?
cpl-1.0 | 0.9 | {lic} | common public {lic}(?: {v1})?
cpal-1.0 | 0.9 | {lic} | common public attribution {lic}(?: {v1})?
ipl-1.0 | 0.9 | {lic} | ibm public {lic}(?: {v1})?
ms-pl | 0.9 | {lic} | microsoft public {lic}
ms-rl | 0.9 | {lic} | microsoft reciprocal {lic}
eupl-1.1 | 0.95 | {lic} | european union public {lic} {v11}
eupl-1.2 | 0.95 | {lic} | european union public {lic} {v12}
eupl | 0.8 | {lic} | european union public {lic}
eupl-1.2 | 0.9 | eupl | eupl {v12}
osl-3.0 | 0.95 | {lic} | open software {lic} {v3}
osl | 0.8 | {lic} | open software {lic}
cecill-2.1 | 0.9 | cecill | cecill {v21}
cecill-b | 0.9 | cecill | cecill b
cecill-c | 0.9 | cecill | cecill c
cecill | 0.8 | cecill | cecill(?: {lic})?
sleepycat | 0.9 | sleepycat | sleepycat(?: software)? {lic}
qpl-1.0 | 0.9 | {lic} | q public {lic}(?: {v1})?
apsl-2.0 | 0.9 | {lic} | apple public source {lic}(?: {v2})?
npl | 0.9 | {lic} | netscape public {lic}
spl-1.0 | 0.9 | {lic} | sun public {lic}(?: {v1})?
lppl-1.3c | 0.95 | latex | latex project public {lic} (?:v|version |v )?1 3c?
lppl | 0.8 | latex | latex project public {lic}
ofl-1.1 | 0.95 | font | (?:sil )?open font {lic} {v11}
ofl | 0.8 | font | (?:sil )?open font {lic}
mulanpsl-2.0 | 0.9 | mulan | mulan permissive software {lic}(?: {v2})?
# Data, models and sources that are open with limits
odbl-1.0 | 0.95 | {lic} | (?:odc )?open database {lic}(?: {v1})?
odbl-1.0 | 0.9 | odbl | odbl(?: {v1})?
odc-by-1.0 | 0.95 | commons | open data commons attribution {lic}(?: {v1})?
pddl-1.0 | 0.95 | dedication | (?:open data commons )?public domain dedication and {lic}(?: {v1})?
cdla-permissive-2.0 | 0.95 | {lic} | community data {lic} agreement permissive {v2}
cdla-sharing-1.0 | 0.95 | {lic} | community data {lic} agreement sharing {v1}
cdla | 0.8 | {lic} | community data {lic} agreement
ogl-uk-3.0 | 0.95 | {lic} | open government {lic} {v3}
ogl-uk | 0.8 | {lic} | open government {lic}
etalab-2.0 | 0.9 | etalab | etalab(?: open)? {lic}(?: {v2})?
dl-de-by-2.0 | 0.9 | datenlizenz | datenlizenz deutschland namensnennung(?: {v2})?
dl-de-zero-2.0 | 0.9 | datenlizenz | datenlizenz deutschland zero(?: {v2})?
openrail | 0.9 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: {lic})?
rail | 0.8 | {lic} | responsible ai {lic}
sspl-1.0 | 0.95 | {lic} | server side public {lic}(?: {v1})?
sspl-1.0 | 0.9 | sspl | sspl(?: {v1})?
busl-1.1 | 0.95 | {lic} | business source {lic}(?: {v11})?
elastic-2.0 | 0.95 | {lic} | elastic {lic}(?: {v2})?
confluent | 0.9 | {lic} | confluent community {lic}
commons-clause | 0.9 | clause | commons clause(?: {lic})?(?: condition)?(?: {v1})?
polyform-nc-1.0.0 | 0.9 | polyform | polyform noncommercial {lic}(?: 1 0 0)?
polyform | 0.8 | polyform | polyform [a-z]+ {lic}
parity | 0.8 | {lic} | parity public {lic}
json | 0.9 | evil | the software shall be used for good not evil
# Hints
public-domain | 0.8 | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | 0.5 | domain | public domain
proprietary | 0.8 | proprietary | proprietary and confidential
proprietary | 0.7 | unauthorized | unauthorized (?:copying|use|distribution|reproduction)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited
proprietary | 0.7 | permission/consent | may not be (?:reproduced|copied|distributed|republished)(?: [^ ]+){0,8} without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
proprietary | 0.6 | reserved | all rights reserved
non-commercial | 0.6 | commercial/noncommercial | for (?:personal and )?(?:noncommercial|non commercial) (?:use|purposes)(?: only)?
dual | 0.6 | dual | dual licen[cs](?:e|es|ed|ing)
see-license | 0.4 | license/copying | see(?: the)?(?: file)? (?:license|copying)(?: file)? for(?: more)? (?:details|information)
license-reference | 0.3 | {lic} | {under} (?:[^ ]+ ){0,4}{lic}
# The phrases of the contract
gpl | 0.8 | gnu | gnu general public license
apache | 0.8 | apache | apache license
cc-by | 0.8 | cc | cc by
mit | 0.8 | license | mit license
"""
BASE = 4
"""The last rules, which count on their own whatever suppresses them."""


LICENSE_WORDS = ("license", "licence", "licenses", "licences")


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    confidence: float
    keywords: tuple[str, ...]
    regex: str


def words_apart(pattern: str) -> str:
    """A pattern over words for text in which every word has a space of its own on both sides."""
    return " " + pattern.replace(" ", "  ") + " "


def _rules() -> list[Rule]:
    lines = [x for x in RULES_TEXT.strip().split("\n") if not x.startswith("#")]
    found = []
    for order, line in enumerate(lines):
        label, confidence, keyword, regex = line.split(" | ", 3)
        keywords = LICENSE_WORDS if keyword == "{lic}" else tuple(keyword.split("/"))
        for name, part in PARTS.items():
            regex = regex.replace("{" + name + "}", part)
        found.append(Rule(order, label, float(confidence), keywords, words_apart(regex)))
    return found


RULES = _rules()
