"""Hand-written licence signatures: label | priority | keywords | pattern.

Patterns run over a text's words, lower-case and joined by single spaces, and
match at word borders. A rule runs only if the text has all its keywords. Of
overlapping detections a contained one gives way to one of higher priority, or of
the same priority if it is longer; 9 is a licence's own text or tag, 7 a grant,
5 a name, 3 a hint.
"""

RULES = r"""
mit|9|permission hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|9|restriction merge publish|without restriction including without limitation the rights to use copy modify merge publish
mit|9|warranty authors|the software is provided as is without warranty of any kind
mit|9|spdx mit|spdx license identifier mit
mit|7|mit licen|(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit|7|expat|(?:licensed|released|distributed) under (?:the )?expat licen[sc]e
mit|5|mit licen|mit licen[sc]e
mit|5|expat|expat licen[sc]e
mit|5|x11|x11 licen[sc]e
mit-0|9|spdx mit|spdx license identifier mit 0
mit-0|5|mit attribution|mit no attribution
mit-modern|7|permission hereby granted fee|permission is hereby granted without written agreement and without license or royalty fees
apache-2.0|9|spdx apache|spdx license identifier apache 2 0
apache-2.0|9|apache|licensed under the apache license version 2 0 the license you may not use this file except
apache-2.0|9|apache january|apache license version 2 0 january 2004
apache-2.0|9|apache|you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0|7|apache|(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache licen[sc]e (?:version )?(?:v )?2(?: 0)?
apache-2.0|7|apache|apache licen[sc]e (?:version )?2(?: 0)?
apache-2.0|5|apache|apache 2 0 licen[sc]e
apache-2.0|5|asl|asl 2 0
apache-1.1|9|spdx apache|spdx license identifier apache 1 1
apache-1.1|7|apache software|the apache software license version 1 1
apache-1.0|7|apache|apache licen[sc]e version 1 0
apache|5|apache|apache (?:software )?licen[sc]e
apache|3|apache foundation|licensed to the apache software foundation
gpl-3.0|9|spdx gpl|spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later|9|spdx gpl|spdx license identifier gpl 3 0 or later
gpl-3.0-or-later|9|general version|gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-3.0|9|general june|gnu general public license version 3 29 june 2007
gpl-3.0|7|general|gnu general public licen[sc]e (?:as published by the free software foundation )?version 3(?: 0)?
gpl-3.0|7|general|(?:gnu )?general public licen[sc]e v3
gpl-3.0|5|gpl|gpl ?(?:version )?v?3(?: 0)?
gpl-2.0|9|spdx gpl|spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later|9|spdx gpl|spdx license identifier gpl 2 0 or later
gpl-2.0-or-later|9|general version|gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-2.0|9|general june|gnu general public license version 2 june 1991
gpl-2.0|7|general|gnu general public licen[sc]e (?:as published by the free software foundation )?version 2(?: 0)?
gpl-2.0|7|general|(?:gnu )?general public licen[sc]e v2
gpl-2.0|5|gpl|gpl ?(?:version )?v?2(?: 0)?
gpl-2.0-classpath|9|classpath|classpath exception(?: to the gpl)?
gpl-2.0-linux-note|9|linux syscall|linux syscall note
gpl-1.0|7|general february|gnu general public license version 1 february 1989
gpl|5|general|gnu general public licen[sc]e
gpl|5|general|general public licen[sc]e
gpl|5|gnu gpl|gnu gpl
gpl|3|copyleft|copyleft licen[sc]e
lgpl-3.0|9|spdx lgpl|spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0|7|lesser|(?:gnu )?lesser general public licen[sc]e (?:version )?v?3(?: 0)?
lgpl-3.0|5|lgpl|lgpl ?v?3(?: 0)?
lgpl-2.1|9|spdx lgpl|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1|9|lesser february|gnu lesser general public license version 2 1 february 1999
lgpl-2.1|7|lesser|(?:gnu )?lesser general public licen[sc]e (?:version )?v?2 1
lgpl-2.1|5|lgpl|lgpl ?v?2 1
lgpl-2.0|7|library general|gnu library general public licen[sc]e(?: version 2)?
lgpl|7|lesser|(?:gnu )?lesser general public licen[sc]e
lgpl|5|lgpl|(?:gnu )?lgpl
agpl-3.0|9|spdx agpl|spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0|9|affero november|gnu affero general public license version 3 19 november 2007
agpl-3.0|7|affero|(?:gnu )?affero general public licen[sc]e (?:version )?v?3(?: 0)?
agpl-3.0|5|agpl|agpl ?v?3(?: 0)?
agpl|7|affero|(?:gnu )?affero general public licen[sc]e
agpl|5|agpl|(?:gnu )?agpl
agpl-1.0|7|affero|affero general public licen[sc]e version 1
gfdl-1.3|7|free documentation|gnu free documentation licen[sc]e version 1 3
gfdl-1.2|7|free documentation|gnu free documentation licen[sc]e version 1 2
gfdl-1.1|7|free documentation|gnu free documentation licen[sc]e version 1 1
gfdl|5|free documentation|gnu free documentation licen[sc]e
gfdl|5|gfdl|gfdl
bsd-3-clause|9|spdx bsd|spdx license identifier bsd 3 clause
bsd-3-clause|9|neither endorse|neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause|7|bsd|(?:the )?(?:new|modified|revised|3 clause|three clause) bsd licen[sc]e
bsd-3-clause|5|bsd|bsd (?:3|three) clause
bsd-2-clause|9|spdx bsd|spdx license identifier bsd 2 clause
bsd-2-clause|7|bsd|(?:the )?(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e
bsd-2-clause|5|bsd|bsd (?:2|two) clause
bsd-4-clause|9|spdx bsd|spdx license identifier bsd 4 clause
bsd-4-clause|9|advertising acknowledgement|all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-clause|5|bsd|(?:original bsd licen[sc]e|bsd 4 clause|4 clause bsd)
bsd-0-clause|9|spdx 0bsd|spdx license identifier 0bsd
bsd-0-clause|5|zero bsd|zero clause bsd
bsd-patent|7|bsd patent|bsd (?:2 clause )?plus patent licen[sc]e
bsd|9|redistribution binary|redistribution and use in source and binary forms with or without modification are permitted provided
bsd|7|bsd|(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)? licen[sc]e
bsd|5|bsd|bsd(?: style)? licen[sc]e
isc|9|spdx isc|spdx license identifier isc
isc|9|permission hereby fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|5|isc|isc licen[sc]e
mpl-2.0|9|spdx mpl|spdx license identifier mpl 2 0
mpl-2.0|9|mozilla form|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0|7|mozilla|mozilla public licen[sc]e (?:version )?v? ?2(?: 0)?
mpl-2.0|5|mpl|mpl ?v?2(?: 0)?
mpl-1.1|9|spdx mpl|spdx license identifier mpl 1 1
mpl-1.1|7|mozilla|mozilla public licen[sc]e (?:version )?1 1
mpl-1.0|7|mozilla|mozilla public licen[sc]e (?:version )?1 0
mpl|5|mozilla|mozilla public licen[sc]e
epl-2.0|9|spdx epl|spdx license identifier epl 2 0
epl-2.0|7|eclipse|eclipse public licen[sc]e (?:version )?v? ?2(?: 0)?
epl-1.0|9|spdx epl|spdx license identifier epl 1 0
epl-1.0|7|eclipse|eclipse public licen[sc]e (?:version )?v? ?1(?: 0)?
epl|5|eclipse|eclipse public licen[sc]e
edl-1.0|7|eclipse distribution|eclipse distribution licen[sc]e (?:version )?v? ?1(?: 0)?
cddl-1.1|7|cddl|(?:cddl|common development and distribution licen[sc]e) (?:version )?1 1
cddl-1.0|7|cddl|cddl (?:version )?1 0
cddl|7|common development distribution|common development and distribution licen[sc]e
cddl|5|cddl|cddl
cpl-1.0|7|common public|common public licen[sc]e (?:version )?1 0
cpl|5|common public|common public licen[sc]e
cpal-1.0|7|attribution common|common public attribution licen[sc]e
ipl-1.0|7|ibm public|ibm public licen[sc]e
apsl-2.0|7|apple public|apple public source licen[sc]e(?: version 2 0)?
aslr|5|apple sample|apple sample code licen[sc]e
artistic-2.0|9|spdx artistic|spdx license identifier artistic 2 0
artistic-2.0|7|artistic|artistic licen[sc]e (?:version )?2(?: 0)?
artistic-1.0|7|artistic|artistic licen[sc]e (?:version )?1(?: 0)?
artistic|5|artistic|(?:the |perl |clarified )?artistic licen[sc]e
perl|7|perl terms|(?:under|on) the same terms as perl(?: itself)?
python-2.0|9|python foundation|python software foundation licen[sc]e(?: version 2)?
python-2.0|5|psf|psf licen[sc]e
python-2.0|5|python licen|python licen[sc]e
cnri-python|7|cnri|cnri (?:open source )?(?:python )?licen[sc]e
ruby|5|ruby licen|ruby licen[sc]e
php-3.01|7|php|php licen[sc]e (?:version )?3 0?1
php|5|php|php licen[sc]e
zlib|9|spdx zlib|spdx license identifier zlib
zlib|9|altered misrepresented|altered source versions must be plainly marked as such and must not be misrepresented
zlib|7|zlib|zlib(?: libpng)? licen[sc]e
libpng|7|libpng|(?:libpng|png reference library) licen[sc]e
bzip2|7|bzip2|bzip2 licen[sc]e
openssl|7|openssl|openssl licen[sc]e
openssl|9|openssl toolkit|this product includes software developed by the openssl project for use in the openssl toolkit
ssleay|7|ssleay|(?:original )?ssleay licen[sc]e
curl|7|curl licen|curl licen[sc]e
ntp|7|ntp licen|ntp licen[sc]e
hpnd|7|historical permission|historical permission notice and disclaimer
tcl|7|tcl|tcl tk licen[sc]e
vim|7|vim licen|vim licen[sc]e
ncsa|9|spdx ncsa|spdx license identifier ncsa
ncsa|7|illinois|university of illinois ncsa open source licen[sc]e
ncsa|5|ncsa|ncsa (?:open source )?licen[sc]e
llvm-exception|9|llvm exception|llvm exceptions?
boost-1.0|9|spdx bsl|spdx license identifier bsl 1 0
boost-1.0|7|boost|boost software licen[sc]e(?: version 1 0)?
postgresql|7|postgresql licen|postgresql licen[sc]e
sleepycat|7|sleepycat|sleepycat licen[sc]e
oracle-bcl|7|oracle binary|oracle binary code licen[sc]e
upl-1.0|7|universal permissive|universal permissive licen[sc]e
ms-pl|7|microsoft public|microsoft public licen[sc]e
ms-rl|7|microsoft reciprocal|microsoft reciprocal licen[sc]e
ms-limited|7|microsoft limited|microsoft limited (?:public|reciprocal|community) licen[sc]e
w3c|7|w3c software|w3c software (?:notice and )?licen[sc]e
w3c|5|w3c licen|w3c licen[sc]e
unicode|7|unicode agreement|unicode inc licen[sc]e agreement
icu|7|icu licen|icu licen[sc]e
ofl-1.1|9|spdx ofl|spdx license identifier ofl 1 1
ofl-1.1|7|sil font|sil open font licen[sc]e(?: version 1 1)?
ofl-1.1|5|font licen|open font licen[sc]e
ubuntu-font|7|ubuntu font|ubuntu font licen[sc]e
bitstream-vera|7|bitstream vera|bitstream vera (?:fonts )?(?:copyright|licen[sc]e)
eupl-1.2|7|european union|european union public licen[sc]e (?:version )?v? ?1 2
eupl-1.1|7|european union|european union public licen[sc]e (?:version )?v? ?1 1
eupl|5|european union|european union public licen[sc]e
eupl|5|eupl|eupl
cecill-2.1|7|cecill|cecill (?:free software )?(?:licen[sc]e )?(?:agreement )?(?:version )?2 1
cecill-b|7|cecill|cecill b
cecill-c|7|cecill|cecill c
cecill|5|cecill|cecill
mulan-2.0|7|mulan|mulan (?:psl|permissive software licen[sc]e)(?: v2| version 2)?
osl-3.0|7|open software|open software licen[sc]e (?:version )?v? ?3(?: 0)?
osl|5|open software|open software licen[sc]e
afl-3.0|7|academic free|academic free licen[sc]e (?:version )?v? ?3(?: 0)?
afl|5|academic free|academic free licen[sc]e
ecl-2.0|7|educational community|educational community licen[sc]e(?: version 2 0)?
qpl-1.0|7|public qt|q public licen[sc]e
rpl-1.5|7|reciprocal public|reciprocal public licen[sc]e(?: 1 5)?
spl-1.0|7|sun public|sun public licen[sc]e
sissl|7|sun industry|sun industry standards source licen[sc]e
npl-1.1|7|netscape|netscape public licen[sc]e
watcom|7|sybase watcom|sybase open watcom public licen[sc]e
lppl-1.3c|7|latex|latex project public licen[sc]e (?:version )?1 3c?
lppl|5|latex|latex project public licen[sc]e
nasa-1.3|7|nasa open|nasa open source agreement
gust|7|gust font|gust font licen[sc]e
beerware|7|beer|the beer ware licen[sc]e
beerware|5|beerware|beerware(?: licen[sc]e)?
wtfpl|9|fuck|do what the fuck you want to public licen[sc]e
wtfpl|5|wtfpl|wtfpl
unlicense|9|unencumbered|this is free and unencumbered software released into the public domain
unlicense|9|spdx unlicense|spdx license identifier unlicense
unlicense|5|unlicense|the unlicense
public-domain|7|public domain|(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain|5|public domain|public domain
cc0-1.0|9|spdx cc0|spdx license identifier cc0 1 0
cc0-1.0|7|cc0|(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0|5|commons zero|creative commons zero
cc-by-4.0|9|spdx cc|spdx license identifier cc by 4 0
cc-by-4.0|7|attribution international|(?:creative commons )?attribution 4 0 international
cc-by-4.0|7|cc by|cc by 4 0
cc-by-3.0|7|cc by|cc by 3 0
cc-by-2.5|7|cc by|cc by 2 5
cc-by-2.0|7|cc by|cc by 2 0
cc-by-sa-4.0|8|cc by sa|cc by sa 4 0
cc-by-sa-4.0|8|attribution sharealike|(?:creative commons )?attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0|8|cc by sa|cc by sa 3 0
cc-by-sa-3.0|8|attribution sharealike|(?:creative commons )?attribution share ?alike 3 0(?: unported)?
cc-by-sa-2.0|8|cc by sa|cc by sa 2 [05]
cc-by-nc-4.0|8|cc by nc|cc by nc 4 0
cc-by-nc-4.0|8|attribution noncommercial|(?:creative commons )?attribution non ?commercial 4 0(?: international)?
cc-by-nc-3.0|8|cc by nc|cc by nc 3 0
cc-by-nc-2.0|8|cc by nc|cc by nc 2 [05]
cc-by-nc-sa-4.0|9|cc by nc sa|cc by nc sa 4 0
cc-by-nc-sa-3.0|9|cc by nc sa|cc by nc sa 3 0
cc-by-nc-sa|8|cc by nc sa|cc by nc sa
cc-by-nc-sa|8|noncommercial sharealike|(?:creative commons )?attribution non ?commercial share ?alike
cc-by-nc-nd-4.0|9|cc by nc nd|cc by nc nd 4 0
cc-by-nc-nd-3.0|9|cc by nc nd|cc by nc nd 3 0
cc-by-nc-nd|8|cc by nc nd|cc by nc nd
cc-by-nc-nd|8|noncommercial noderiv|(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nd-4.0|8|cc by nd|cc by nd 4 0
cc-by-nd-3.0|8|cc by nd|cc by nd 3 0
cc-by-nd|7|cc by nd|cc by nd
cc-by-nc|7|cc by nc|cc by nc
cc-by-sa|7|cc by sa|cc by sa
cc-by|6|cc by licen|(?:licensed|released|available) under (?:a |the )?cc by(?! (?:nc|nd|sa)(?![^ ]))
cc|5|creative commons|creative commons(?: licen[sc]e)?
odbl-1.0|7|open database|open database licen[sc]e
odbl-1.0|5|odbl|odbl
odc-by-1.0|7|open data attribution|open data commons attribution licen[sc]e
pddl-1.0|7|public domain dedication|(?:open data commons )?public domain dedication and licen[sc]e
cdla-permissive|7|community data permissive|community data licen[sc]e agreement permissive
cdla-sharing|7|community data sharing|community data licen[sc]e agreement sharing
ogl-uk|7|open government|open government licen[sc]e
etalab|7|licence ouverte|licence ouverte(?: open licence)?
sspl-1.0|7|server side public|server side public licen[sc]e
bsl-1.1|7|business source|business source licen[sc]e(?: 1 1)?
elastic-2.0|7|elastic licen|elastic licen[sc]e(?: 2 0| v2)?
confluent|7|confluent community|confluent community licen[sc]e
commons-clause|7|commons clause|commons clause
polyform|7|polyform|polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial)(?: licen[sc]e)?
prosperity|7|prosperity|prosperity public licen[sc]e
parity|7|parity public|parity public licen[sc]e
hippocratic|7|hippocratic|hippocratic licen[sc]e
openrail|7|openrail|(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?
json|9|good evil|the software shall be used for good not evil
json|5|json licen|json licen[sc]e
jsf|7|java specification|java specification licen[sc]e
free-art-1.3|7|free art|free art licen[sc]e
proprietary|7|proprietary confidential|proprietary and confidential
proprietary|5|rights reserved|all rights reserved
commercial|5|commercial licen|commercial licen[sc]e
"""


def rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """(label, priority, keywords, pattern) in the order of the table."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keywords, pattern = line.split("|", 3)
        out.append((label, int(priority), tuple(keywords.split()), pattern))
    return out
