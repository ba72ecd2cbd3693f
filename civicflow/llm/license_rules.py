"""Signature rules of licenses.

One rule a line: priority | label | keywords | pattern.  Patterns are regular
expressions over the lower-cased words of a text (runs of letters and digits,
one space between them) and match whole words.  A rule is tried only where one
of its keywords occurs as a word.  Priorities: 1 a sentence of the license or its
standard notice, 2 a full name, 3 an identifier or a short name, 4 a hint.  Earlier rules go
before later ones of the same priority.
"""

from __future__ import annotations

#: Phrases that always count, and their labels (fixed by the contract of the query).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: How sure a detection of each priority is.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}

_RULES = r"""
1 | mit | sell | to use copy modify merge publish distribute sublicense and or sell copies of the software
1 | mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 | mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
1 | mit-0 | attribution | mit no attribution
1 | mit-modern | modern | mit modern variant
1 | mit-advertising | advertising | mit license with advertising clause
1 | apache-2 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 | apache-2 | apache | you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
1 | apache-2 | perpetual,apache | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of
1 | apache-1.1 | apache | this product includes software developed by the apache software foundation
1 | apache-1.0 | apache | this product includes software developed by the apache group for use in the apache http server project
1 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
1 | bsd-3-clause | endorse | neither the names? of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software
1 | bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
1 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
1 | bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
1 | 0bsd | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
1 | isc | isc,fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
1 | hpnd | fee | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
1 | ntp | fee | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
1 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
1 | zlib | misrepresented | the origin of this software must not be misrepresented
1 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 | wtfpl | fuck | you just do what the fuck you want to
1 | beerware | beer | you can buy me a beer in return
1 | bsl-1 | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
1 | ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
1 | ofl-1.1 | reserved | reserved font name
1 | gpl-2-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 | gpl-3-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | gpl-1-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
1 | gpl-2 | gnu | under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2) as published by the free software foundation
1 | gpl-3 | gnu | under the terms of (?:version 3 of the gnu general public license|the gnu general public license version 3) as published by the free software foundation
1 | gpl | gnu | you should have received a copy of the gnu general public license along with this program
1 | lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
1 | agpl | affero | you should have received a copy of the gnu affero general public license along with this program
1 | lgpl-2-or-later | library | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 | lgpl-2.1-or-later | lesser | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
1 | lgpl-3-or-later | lesser | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | agpl-3-or-later | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
1 | gpl-classpath | independent | as a special exception the copyright holders of this library give you permission to link this library with independent modules
1 | mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
1 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
1 | mpl-1.0 | mozilla | the contents of this file are subject to the mozilla public license version 1 0
1 | npl-1.1 | netscape | the contents of this file are subject to the netscape public license version 1 1
1 | cddl-1 | cddl,development | the contents of this file are subject to the terms of the common development and distribution license
1 | epl-1 | eclipse | made available under the terms of the eclipse public license v1 0
1 | epl-2 | eclipse | made available under the terms of the eclipse public license (?:v )?2 0
1 | copyleft-text | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
1 | perl | perl | this (?:library|program|module) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself
1 | ms-pl | microsoft,accept | if you use the software you accept this license if you do not accept the license do not use the software
1 | cc0-1.0 | affirmer | to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives
1 | cc-by-4 | attribution | this work is licensed under (?:a|the) creative commons attribution 4 0 international (?:public )?license
1 | cc-by-sa-4 | sharealike,share | this work is licensed under (?:a|the) creative commons attribution share ?alike 4 0 international (?:public )?license
1 | cc-by-nc-4 | commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial 4 0 international (?:public )?license
1 | cc-by-nd-4 | commons | this work is licensed under (?:a|the) creative commons attribution no ?derivatives 4 0 international (?:public )?license
1 | odbl-1 | odbl,database | made available under the open database license
1 | pddl-1 | pddl,dedication | made available under the public domain dedication and license
1 | openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
1 | ssleay | eric | this product includes cryptographic software written by eric young
1 | python | python | psf is making python available to licensee on an as is basis
1 | icu | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
1 | ijg | jpeg | this software is based in part on the work of the independent jpeg group
1 | ftl | freetype | portions of this software are copyright (?:[^ ]+ ){0,4}the freetype project
1 | json | evil | the software shall be used for good not evil
1 | elastic-2 | elastic | elastic license 2 0 (?:and )?(?:the )?(?:server side public license|limitations)
1 | busl-1.1 | business | business source license 1 1
1 | commons-clause | sell | the license does not grant to you the right to sell the software
1 | proprietary | confidential | proprietary and confidential
1 | proprietary | reproduced | no part of this (?:publication|document|work|book) may be reproduced
1 | proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
2 | mit | mit,expat | (?:mit|expat) licen[sc]e
2 | mit | mit | (?:under|terms of) (?:the )?mit
2 | apache-2 | apache | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
2 | apache-2 | apache | apache (?:software )?licen[sc]e v2(?: 0)?
2 | apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version |v )?1 1
2 | apache-1.0 | apache | apache (?:software )?licen[sc]e (?:version |v )?1 0
2 | apache | apache | apache (?:software |public )?licen[sc]e
2 | bsd-2-clause | simplified,freebsd | (?:simplified bsd|freebsd) licen[sc]e
2 | bsd-2-clause | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
2 | bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
2 | bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[sc]e
2 | bsd-4-clause | bsd | (?:4|four) clause bsd(?: licen[sc]e)?
2 | bsd-4-clause | bsd | (?:original|old) bsd licen[sc]e
2 | 0bsd | bsd | (?:0|zero) clause bsd(?: licen[sc]e)?
2 | bsd-patent | bsd | bsd (?:2 clause )?plus patent licen[sc]e
2 | bsd | bsd | bsd (?:style )?licen[sc]e
2 | isc | isc | isc licen[sc]e
2 | zlib | zlib | zlib(?: libpng)? licen[sc]e
2 | libpng | libpng,png | (?:libpng|png reference library) licen[sc]e
2 | bsl-1 | boost | boost software licen[sc]e(?: version)?(?: 1 0)?
2 | gpl-3-or-later | gnu | gnu general public licen[sc]e (?:version |v )?3(?: 0)? or (?:any )?later(?: version)?
2 | gpl-2-or-later | gnu | gnu general public licen[sc]e (?:version |v )?2(?: 0)? or (?:any )?later(?: version)?
2 | gpl-3 | gnu,general | (?:gnu )?general public licen[sc]e (?:version |v )?3(?: 0)?
2 | gpl-3 | gnu,general | version 3 of the (?:gnu )?general public licen[sc]e
2 | gpl-2 | gnu,general | (?:gnu )?general public licen[sc]e (?:version |v )?2(?: 0)?
2 | gpl-2 | gnu,general | version 2 of the (?:gnu )?general public licen[sc]e
2 | gpl-1 | gnu | gnu general public licen[sc]e (?:version |v )1(?: 0)?
2 | gpl | gnu | gnu general public licen[sc]e
2 | gpl | gnu | gnu public licen[sc]e
2 | lgpl-2.1 | lesser | lesser general public licen[sc]e (?:version |v )?2 1
2 | lgpl-3 | lesser | lesser general public licen[sc]e (?:version |v )?3(?: 0)?
2 | lgpl-2 | library | library general public licen[sc]e (?:version |v )?2(?: 0)?
2 | lgpl | lesser,library | gnu (?:lesser|library) general public licen[sc]e
2 | agpl-3 | affero | affero general public licen[sc]e (?:version |v )?3(?: 0)?
2 | agpl-1 | affero | affero general public licen[sc]e (?:version |v )?1(?: 0)?
2 | agpl | affero | (?:gnu )?affero general public licen[sc]e
2 | gfdl-1.3 | documentation | free documentation licen[sc]e (?:version |v )?1 3
2 | gfdl-1.2 | documentation | free documentation licen[sc]e (?:version |v )?1 2
2 | gfdl-1.1 | documentation | free documentation licen[sc]e (?:version |v )?1 1
2 | gfdl | documentation | gnu free documentation licen[sc]e
2 | mpl-2 | mozilla | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
2 | mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v )?1 1
2 | mpl-1.0 | mozilla | mozilla public licen[sc]e (?:version |v )?1 0
2 | mpl | mozilla | mozilla public licen[sc]e
2 | npl-1.0 | netscape | netscape public licen[sc]e (?:version |v )?1 0
2 | npl | netscape | netscape public licen[sc]e
2 | cddl-1.1 | development | common development and distribution licen[sc]e (?:cddl )?(?:version |v )?1 1
2 | cddl-1 | development | common development and distribution licen[sc]e(?: cddl)?(?: (?:version |v )?1 0)?
2 | epl-2 | eclipse | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
2 | epl-1 | eclipse | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
2 | epl | eclipse | eclipse public licen[sc]e
2 | edl-1 | eclipse | eclipse distribution licen[sc]e
2 | cpl-1 | common | common public licen[sc]e(?: (?:version |v )?1 0)?
2 | ipl-1 | ibm | ibm public licen[sc]e(?: (?:version |v )?1 0)?
2 | spl-1 | sun | sun public licen[sc]e(?: (?:version |v )?1 0)?
2 | apsl-2 | apple | apple public source licen[sc]e (?:version |v )?2 0
2 | apsl-1 | apple | apple public source licen[sc]e (?:version |v )?1 [0-2]
2 | eupl-1.2 | union | european union public licen[sc]e (?:version |v )?1 2
2 | eupl-1.1 | union | european union public licen[sc]e (?:version |v )?1 1
2 | eupl | union | european union public licen[sc]e
2 | cecill-2.1 | cecill | cecill (?:free software )?licen[sc]e (?:agreement )?(?:version |v )?2 1
2 | cecill-b | cecill | cecill b(?: licen[sc]e)?
2 | cecill-c | cecill | cecill c(?: licen[sc]e)?
2 | cecill | cecill | (?:licence )?cecill(?: licen[sc]e)?
2 | osl-3 | open | open software licen[sc]e (?:version |v )?3 0
2 | osl-2.1 | open | open software licen[sc]e (?:version |v )?2 1
2 | osl | open | open software licen[sc]e
2 | afl-3 | academic | academic free licen[sc]e (?:version |v )?3 0
2 | afl | academic | academic free licen[sc]e
2 | ecl-2 | educational | educational community licen[sc]e (?:version |v )?2 0
2 | artistic-2 | artistic | artistic licen[sc]e (?:version |v )?2 0
2 | artistic-1 | artistic | artistic licen[sc]e (?:version |v )?1 0
2 | artistic | artistic | artistic licen[sc]e
2 | ms-pl | microsoft | microsoft public licen[sc]e
2 | ms-rl | microsoft | microsoft reciprocal licen[sc]e
2 | ofl-1.1 | sil,font | (?:sil )?open font licen[sc]e(?: (?:version |v )?1 1)?
2 | ncsa | illinois,ncsa | (?:university of illinois ncsa|ncsa) open source licen[sc]e
2 | postgresql | postgresql | postgresql licen[sc]e
2 | python | python | python (?:software foundation )?licen[sc]e(?: (?:version |v )?2)?
2 | php-3 | php | php licen[sc]e(?: (?:version |v )?3(?: 0)?1?)?
2 | ruby | ruby | ruby licen[sc]e
2 | openssl | openssl | openssl licen[sc]e
2 | w3c | w3c | w3c software (?:notice and |and document )?licen[sc]e
2 | unicode | unicode | unicode (?:terms of use|licen[sc]e agreement|licen[sc]e v3)
2 | curl | curl | curl licen[sc]e
2 | x11 | x11 | x11 licen[sc]e
2 | vim | vim | vim licen[sc]e
2 | zpl-2.1 | zope | zope public licen[sc]e(?: (?:version |v )?2 1)?
2 | qpl-1 | qt,q | q public licen[sc]e(?: (?:version |v )?1 0)?
2 | upl-1 | universal | universal permissive licen[sc]e(?: (?:version |v )?1 0)?
2 | mulan-2 | mulan | mulan (?:psl|permissive software licen[sc]e) ?v?2
2 | blueoak-1 | oak | blue oak model licen[sc]e(?: 1 0 0)?
2 | sspl-1 | server | server side public licen[sc]e(?: (?:version |v )?1)?
2 | elastic-2 | elastic | elastic licen[sc]e (?:version |v )?2(?: 0)?
2 | busl-1.1 | business | business source licen[sc]e
2 | polyform-nc-1 | polyform | polyform noncommercial licen[sc]e(?: 1 0 0)?
2 | polyform-sb-1 | polyform | polyform small business licen[sc]e(?: 1 0 0)?
2 | commons-clause | commons | commons clause
2 | unlicense | unlicense | (?:the )?unlicense
2 | wtfpl | wtfpl | wtfpl(?: licen[sc]e)?
2 | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
2 | cc0-1.0 | zero | creative commons zero
2 | cc-by-nc-sa | commons | creative commons attribution non ?commercial share ?alike
2 | cc-by-nc-nd | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
2 | cc-by-nc | commons | creative commons attribution non ?commercial
2 | cc-by-sa | commons | creative commons attribution share ?alike
2 | cc-by-nd | commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
2 | cc-by | commons | creative commons attribution
2 | odbl-1 | database | open database licen[sc]e
2 | odc-by-1 | commons | open data commons attribution licen[sc]e
2 | pddl-1 | commons | open data commons public domain dedication
2 | ogl-uk-3 | government | open government licen[sc]e(?: v3 0)?
2 | etalab-2 | etalab,ouverte | (?:etalab open licen[sc]e|licence ouverte)(?: 2 0)?
2 | lal-1.3 | art | free art licen[sc]e(?: 1 3)?
2 | openrail | rail,openrail | (?:creativeml )?open ?rail(?: m)?(?: licen[sc]e)?
2 | llama | llama | llama (?:[0-9] )?(?:[0-9] )?community licen[sc]e
2 | public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
2 | all-rights-reserved | reserved | all rights reserved
3 | mit | mit | spdx licen[sc]e identifier mit
3 | apache-2 | apache | spdx licen[sc]e identifier apache 2 0
3 | bsd-2-clause | bsd | bsd 2 clause
3 | bsd-3-clause | bsd | bsd 3 clause
3 | bsd-4-clause | bsd | bsd 4 clause
3 | 0bsd | 0bsd | 0bsd
3 | isc | isc | spdx licen[sc]e identifier isc
3 | zlib | zlib | spdx licen[sc]e identifier zlib
3 | bsl-1 | bsl | bsl 1 0
3 | busl-1.1 | busl | busl 1 1
3 | apache-2 | apache | apache 2 0
3 | apache-2 | asl,al2 | (?:asl 2 0|al2)
3 | gpl-3-or-later | gpl | gpl 3 0 or later
3 | gpl-2-or-later | gpl | gpl 2 0 or later
3 | gpl-3 | gpl | gpl (?:v )?3(?: 0)?(?: only)?
3 | gpl-2 | gpl | gpl (?:v )?2(?: 0)?(?: only)?
3 | gpl-3 | gplv3 | (?:gnu )?gplv3
3 | gpl-2 | gplv2 | (?:gnu )?gplv2
3 | lgpl-3 | lgpl | lgpl (?:v )?3(?: 0)?(?: only)?
3 | lgpl-2.1 | lgpl | lgpl (?:v )?2 1(?: only)?
3 | lgpl-3-or-later | lgpl | lgpl 3 0 or later
3 | lgpl-2.1-or-later | lgpl | lgpl 2 1 or later
3 | lgpl-3 | lgplv3 | (?:gnu )?lgplv3
3 | lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
3 | agpl-3 | agpl,agplv3 | (?:gnu )?(?:agpl (?:v )?3(?: 0)?|agplv3)(?: only)?
3 | mpl-2 | mpl,mplv2 | (?:mpl (?:v )?2(?: 0)?|mplv2)
3 | mpl-1.1 | mpl | mpl (?:v )?1 1
3 | epl-2 | epl | epl (?:v )?2 0
3 | epl-1 | epl | epl (?:v )?1 0
3 | cddl-1 | cddl | cddl(?: 1 [01])?
3 | eupl-1.2 | eupl | eupl(?: 1 2)?
3 | sspl-1 | sspl | sspl(?: 1 0)?
3 | ofl-1.1 | ofl | ofl 1 1
3 | ncsa | ncsa | spdx licen[sc]e identifier ncsa
3 | psf-2 | psf | psf 2 0
3 | cc-by-nc-sa-4 | cc | cc by nc sa 4 0
3 | cc-by-nc-nd-4 | cc | cc by nc nd 4 0
3 | cc-by-nc-4 | cc | cc by nc 4 0
3 | cc-by-sa-4 | cc | cc by sa 4 0
3 | cc-by-nd-4 | cc | cc by nd 4 0
3 | cc-by-4 | cc | cc by 4 0
3 | cc-by-sa-3 | cc | cc by sa 3 0
3 | cc-by-3 | cc | cc by 3 0
3 | cc-by-nc-sa | cc | cc by nc sa
3 | cc-by-nc-nd | cc | cc by nc nd
3 | cc-by-sa | cc | cc by sa
3 | cc-by-nd | cc | cc by nd
3 | cc-by | cc | cc by
3 | cc0-1.0 | cc | cc zero
3 | odbl-1 | odbl | odbl
3 | public-domain | domain | public domain
4 | gpl | gpl | (?:gnu )?gpl
4 | lgpl | lgpl | (?:gnu )?lgpl
4 | agpl | agpl | (?:gnu )?agpl
4 | bsd | bsd | bsd licensed
4 | mit | mit | mit licensed
4 | creative-commons | commons | creative commons
4 | unknown-license | license,licence,copying | see (?:the )?(?:file )?(?:license|licence|copying)(?: txt| md)?(?: file)? for (?:details|more information|terms)
4 | unknown-license | licensed | (?:is )?licensed under (?:the )?(?:terms of|following)
4 | unknown-license | spdx | spdx licen[sc]e identifier [^ ]+
4 | unknown-license | copyright | copyright (?:c )?[12][0-9][0-9][0-9]
"""


def rules() -> list[tuple[int, int, str, list[str], str]]:
    """``number, priority, label, keywords, pattern`` in order; the fixed phrases come first."""
    found = [(2, label, [phrase.split()[-1] if label == "mit" else phrase.split()[0]], phrase) for phrase, label in BASE.items()]
    for line in filter(None, _RULES.splitlines()):
        priority, label, keywords, pattern = line.split(" | ")
        found.append((int(priority), label, keywords.split(","), pattern))
    return [(i, *rule) for i, rule in enumerate(found)]
