"""License scans with DataFrame functions alone: ordered signature rules behind a keyword gate.

A text is normalised to words (small ASCII letters, digits, characters beyond ASCII) with single
spaces. One pass over the texts finds, for every document, its words, the base places, and the rules
that its words choose: each rule has a keyword that all its alternatives contain, and only rules whose
keyword the document holds are tried. What leaves a text is the lengths between a rule's places.

Every place of a rule is an interval with a priority; an interval within another of the same or a
higher priority is suppressed (of equal intervals, the rule that comes first in the table stays). The
surviving rules' labels join the base labels.

Defined cases: a null text is empty and gives zeros, null positions and empty labels; rows with the
same or a null id are told apart by their text and each get a row; an empty table gives an empty
result. Extra columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the base contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Pieces that many signatures share.
PIECES = {
    "<under>": r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?",
    "<v>": r"(?: version)?(?: v?[0-9]+)*",
    "<l>": r" licen[cs]e",
}

#: Signatures in the order in which equal intervals are resolved: label, priority, keyword, and the
#: pattern over normalised words. Priorities: 5 identifiers, 4 addresses, grants and statements that
#: name a license, 3 names and sentences of its text, 2 labels like "license: mit", 1 general notices.
SIGNATURES = r"""
mit 5 mit | spdx license identifier mit(?: 0)?
mit 4 mit | <under>mit(?: x11)?(?:<l>)?<v>
mit 3 mit | mit(?: x11| expat| style)?<l><v>
mit 2 mit | licen[cs]e mit
mit 4 opensource | opensource org licenses mit
mit 4 mit | mit license org
mit 3 permission | permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit 3 sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit 3 substantial | this permission notice shall be included in all copies or substantial portions of the software
mit 2 merchantability | including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit 2 tort | whether in an action of contract tort or otherwise arising from out of or in connection with the software
x11 5 x11 | spdx license identifier x11
x11 3 x11 | x11<l>
x11 3 consortium | the name of the x consortium shall not be used in advertising
apache 5 apache | spdx license identifier apache [12] [01]
apache 4 apache | <under>apache(?: software)?(?: foundation)?(?:<l>)?<v>
apache 3 apache | apache(?: software)?(?: foundation)?<l><v>
apache 2 apache | licen[cs]e apache<v>
apache 4 apache | apache org licenses(?: license 2 0)?
apache 4 opensource | opensource org licenses apache 2 0
apache 4 contributor | licensed to the apache software foundation asf under one or more contributor license agreements
apache 3 compliance | you may not use this file except in compliance with the license
apache 3 conditions | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache 3 perpetual | a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache 2 governing | see the license for the specific language governing permissions and limitations under the license
gpl 5 gpl | spdx license identifier gpl [123] 0(?: only| or later)?
gpl 4 gpl | <under>(?:gnu )?gpl(?:<l>)?<v>
gpl 4 gplv1 | <under>(?:gnu )?gplv1(?:<l>)?
gpl 4 gplv2 | <under>(?:gnu )?gplv2(?:<l>)?
gpl 4 gplv3 | <under>(?:gnu )?gplv3(?:<l>)?
gpl 4 gnu | <under>gnu general public(?:<l>)?<v>
gpl 3 gpl | (?:gnu )?gpl<l><v>
gpl 3 gplv1 | (?:gnu )?gplv1<l>
gpl 3 gplv2 | (?:gnu )?gplv2<l>
gpl 3 gplv3 | (?:gnu )?gplv3<l>
gpl 3 gnu | gnu general public<l><v>
gpl 2 gpl | licen[cs]e (?:gnu )?gpl<v>
gpl 2 gplv1 | licen[cs]e (?:gnu )?gplv1
gpl 2 gplv2 | licen[cs]e (?:gnu )?gplv2
gpl 2 gplv3 | licen[cs]e (?:gnu )?gplv3
gpl 4 gnu | gnu org(?: copyleft gpl| licenses gpl| licenses old licenses gpl 2 0)
gpl 4 redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl 3 recipient | each time you redistribute the program or any work based on the program the recipient automatically receives a license
gpl 3 sake | for both users and authors sake the gpl requires that modified versions be marked as changed
gpl 2 gnu | you should have received a copy of the gnu general public license
lgpl 5 lgpl | spdx license identifier lgpl [23] [01](?: only| or later)?
lgpl 4 lgpl | <under>(?:gnu )?lgpl(?:<l>)?<v>
lgpl 4 lgplv2 | <under>(?:gnu )?lgplv2(?:<l>)?<v>
lgpl 4 lgplv3 | <under>(?:gnu )?lgplv3(?:<l>)?
lgpl 4 lesser | <under>(?:gnu )?lesser general public(?:<l>)?<v>
lgpl 3 lgpl | (?:gnu )?lgpl<l><v>
lgpl 3 lgplv2 | (?:gnu )?lgplv2<l><v>
lgpl 3 lgplv3 | (?:gnu )?lgplv3<l>
lgpl 3 lesser | (?:gnu )?lesser general public<l><v>
lgpl 3 library | gnu library general public<l><v>
lgpl 2 lgpl | licen[cs]e (?:gnu )?lgpl<v>
lgpl 2 lgplv2 | licen[cs]e (?:gnu )?lgplv2
lgpl 2 lgplv3 | licen[cs]e (?:gnu )?lgplv3
lgpl 4 gnu | gnu org(?: licenses lgpl| copyleft lesser| licenses old licenses lgpl 2 1)
lgpl 4 redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl 5 agpl | spdx license identifier agpl [13] 0(?: only| or later)?
agpl 4 agpl | <under>(?:gnu )?agpl(?:<l>)?<v>
agpl 4 agplv3 | <under>(?:gnu )?agplv3(?:<l>)?
agpl 4 affero | <under>(?:gnu )?affero general public(?:<l>)?<v>
agpl 3 agpl | (?:gnu )?agpl<l><v>
agpl 3 agplv3 | (?:gnu )?agplv3<l>
agpl 3 affero | (?:gnu )?affero general public<l><v>
agpl 2 agpl | licen[cs]e (?:gnu )?agpl<v>
agpl 2 agplv3 | licen[cs]e (?:gnu )?agplv3
agpl 4 gnu | gnu org licenses agpl
agpl 4 affero | it under the terms of the gnu affero general public license
gfdl 5 gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl 4 gfdl | <under>(?:gnu )?gfdl(?:<l>)?<v>
gfdl 4 documentation | <under>(?:gnu )?free documentation(?:<l>)?<v>
gfdl 3 gfdl | (?:gnu )?gfdl<l><v>
gfdl 3 documentation | (?:gnu )?free documentation<l><v>
gfdl 2 gfdl | licen[cs]e (?:gnu )?gfdl<v>
gfdl 2 documentation | licen[cs]e (?:gnu )?free documentation
gfdl 4 gnu | gnu org licenses fdl
gfdl 3 invariant | with no invariant sections no front cover texts and no back cover texts
bsd 5 bsd | spdx license identifier bsd [1234] clause(?: clear| patent| lbnl)?
bsd 5 0bsd | spdx license identifier 0bsd
bsd 4 bsd | <under>(?:new |modified |simplified |revised )?(?:[234] clause )?bsd(?: [0234] clause)?(?:<l>)?
bsd 3 bsd | (?:new |modified |simplified |revised |original )?(?:[234] clause )?bsd(?: [0234] clause| style)?<l>
bsd 2 bsd | licen[cs]e bsd(?: [0234] clause)?
bsd 4 opensource | opensource org licenses bsd(?: license| [23] clause)
bsd 3 redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd 3 redistributions | redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice this list of conditions and the following disclaimer
bsd 3 endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd 3 acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd 2 exemplary | direct indirect incidental special exemplary or consequential damages
bsd 3 regents | the regents of the university of california
mpl 5 mpl | spdx license identifier mpl [12] [01]
mpl 4 mpl | <under>mpl(?:<l>)?<v>
mpl 4 mozilla | <under>mozilla public(?:<l>)?<v>
mpl 3 mpl | mpl<l><v>
mpl 3 mozilla | mozilla public<l><v>
mpl 2 mpl | licen[cs]e mpl<v>
mpl 4 mozilla | mozilla org(?: en us)? mpl
mpl 4 mozilla | this source code form is subject to the terms of the mozilla public license
mpl 3 mpl | if a copy of the mpl was not distributed with this file
epl 5 epl | spdx license identifier epl [12] 0
epl 4 eclipse | <under>eclipse public(?:<l>)?<v>
epl 3 eclipse | eclipse public<l><v>
epl 2 epl | licen[cs]e epl<v>
epl 4 eclipse | eclipse org legal epl(?: v10| 2 0)
epl 3 eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
edl 5 edl | spdx license identifier edl 1 0
edl 3 eclipse | eclipse distribution<l><v>
edl 4 eclipse | eclipse org org documents edl v10
cddl 5 cddl | spdx license identifier cddl 1 [01]
cddl 4 cddl | <under>cddl(?:<l>)?<v>
cddl 4 development | <under>common development and distribution(?:<l>)?<v>
cddl 3 cddl | cddl<l><v>
cddl 3 development | common development and distribution<l><v>
cddl 2 cddl | licen[cs]e cddl<v>
cddl 4 cddl | (?:sun com|opensource org licenses) cddl
cc-by-nc-nd 5 cc | spdx license identifier cc by nc nd<v>
cc-by-nc-nd 4 cc | <under>(?:a )?cc by nc nd(?:<l>)?<v>
cc-by-nc-nd 3 cc | cc by nc nd(?:<l>| [1234] 0)
cc-by-nc-nd 4 creativecommons | creativecommons org licenses by nc nd
cc-by-nc-nd 3 noderivatives | attribution noncommercial noderivatives<v>(?: international| unported)?
cc-by-nc-sa 5 cc | spdx license identifier cc by nc sa<v>
cc-by-nc-sa 4 cc | <under>(?:a )?cc by nc sa(?:<l>)?<v>
cc-by-nc-sa 3 cc | cc by nc sa(?:<l>| [1234] 0)
cc-by-nc-sa 4 creativecommons | creativecommons org licenses by nc sa
cc-by-nc-sa 3 sharealike | attribution noncommercial sharealike<v>(?: international| unported)?
cc-by-nc 5 cc | spdx license identifier cc by nc<v>
cc-by-nc 4 cc | <under>(?:a )?cc by nc(?:<l>)?<v>
cc-by-nc 3 cc | cc by nc(?:<l>| [1234] 0)
cc-by-nc 4 creativecommons | creativecommons org licenses by nc
cc-by-nc 3 noncommercial | creative commons attribution noncommercial<v>(?: international| unported)?
cc-by-nd 5 cc | spdx license identifier cc by nd<v>
cc-by-nd 4 cc | <under>(?:a )?cc by nd(?:<l>)?<v>
cc-by-nd 3 cc | cc by nd(?:<l>| [1234] 0)
cc-by-nd 4 creativecommons | creativecommons org licenses by nd
cc-by-nd 3 noderivatives | creative commons attribution noderivatives<v>
cc-by-sa 5 cc | spdx license identifier cc by sa<v>
cc-by-sa 4 cc | <under>(?:a )?cc by sa(?:<l>)?<v>
cc-by-sa 3 cc | cc by sa(?:<l>| [1234] [05])
cc-by-sa 4 creativecommons | creativecommons org licenses by sa
cc-by-sa 3 sharealike | (?:creative commons attribution|cc) sharealike<v>(?: international| unported)?
cc-by 5 cc | spdx license identifier cc by<v>
cc-by 4 cc | <under>(?:a )?cc by(?:<l>)?<v>
cc-by 3 cc | cc by(?:<l>| [1234] [05])
cc-by 4 creativecommons | creativecommons org licenses by
cc-by 3 attribution | creative commons attribution<v>(?: international| unported)?
cc0 5 cc0 | spdx license identifier cc0 1 0
cc0 4 cc0 | <under>cc0(?: 1 0)?(?: universal)?
cc0 3 cc0 | cc0(?: 1 0)?(?: universal)?(?:<l>| public domain dedication)
cc0 2 cc0 | licen[cs]e cc0<v>
cc0 4 publicdomain | creativecommons org publicdomain zero
cc0 3 waived | to the extent possible under law the (?:author|person who associated cc0 with this work) has waived all copyright
unlicense 5 unlicense | spdx license identifier unlicense
unlicense 4 unlicense | <under>unlicense
unlicense 3 unlicense | the unlicense
unlicense 4 unlicense | unlicense org
unlicense 3 unencumbered | this is free and unencumbered software released into the public domain
unlicense 3 detriment | for the benefit of the public at large and to the detriment of our heirs and successors
wtfpl 5 wtfpl | spdx license identifier wtfpl
wtfpl 4 wtfpl | <under>wtfpl<v>
wtfpl 3 wtfpl | wtfpl(?:<l>| version [12])
wtfpl 4 wtfpl | wtfpl net
wtfpl 3 fuck | do what the fuck you want to public license
isc 5 isc | spdx license identifier isc
isc 4 isc | <under>isc(?:<l>)?
isc 3 isc | isc<l>
isc 2 isc | licen[cs]e isc
isc 4 opensource | opensource org licenses isc
isc 3 permission | permission to use copy modify and or distribute this software for any purpose(?: with or without fee is hereby granted)?
zlib 5 zlib | spdx license identifier zlib
zlib 4 zlib | <under>zlib(?: libpng)?(?:<l>)?
zlib 3 zlib | zlib(?: libpng)?<l>
zlib 4 zlib | zlib net zlib license
zlib 3 altered | altered source versions must be plainly marked as such
zlib 3 misrepresented | the origin of this software must not be misrepresented
zlib 2 arising | in no event will the authors be held liable for any damages arising from the use of this software
boost 5 bsl | spdx license identifier bsl 1 0
boost 4 boost | <under>boost software(?:<l>)?<v>
boost 3 boost | boost software<l><v>
boost 4 boost | boost org license 1 0
boost 3 executable | unless such copies or derivative works are solely in the form of machine executable object code
artistic 5 artistic | spdx license identifier artistic [12] 0(?: cl8| perl)?
artistic 4 artistic | <under>(?:clarified )?artistic(?:<l>)?<v>
artistic 3 artistic | (?:clarified )?artistic<l><v>
artistic 4 opensource | opensource org licenses artistic license 2 0
artistic 3 holder | the copyright holder maintains some semblance of artistic control over the development of the package
python 5 psf | spdx license identifier psf 2 0
python 5 python | spdx license identifier python 2 0
python 4 python | <under>python(?: software foundation)?<l><v>
python 3 python | python(?: software foundation)?<l>(?: agreement)?<v>
python 4 python | docs python org license
python 3 psf | psf hereby grants licensee a nonexclusive royalty free world wide license
php 5 php | spdx license identifier php 3 0?1?
php 3 php | php<l><v>
php 4 php | php net license
php 3 php | this product includes php software freely available from
ruby 5 ruby | spdx license identifier ruby
ruby 3 ruby | ruby(?: s)?<l>
ruby 4 ruby | ruby lang org en about license
perl 3 perl | (?:same terms as|under the same license as) perl(?: itself)?
perl 4 perl | dev perl org licenses
postgresql 5 postgresql | spdx license identifier postgresql
postgresql 3 postgresql | postgresql<l>
postgresql 4 postgresql | postgresql org about licence
openssl 5 openssl | spdx license identifier openssl
openssl 3 openssl | openssl(?: and ssleay)?<l>
openssl 4 openssl | openssl org source license
openssl 3 openssl | this product includes software developed by the openssl project
ofl 5 ofl | spdx license identifier ofl 1 [01]
ofl 4 sil | <under>sil open font(?:<l>)?<v>
ofl 3 sil | sil open font<l><v>
ofl 4 sil | scripts sil org ofl
ofl 3 font | the font software may be modified altered or added to
eupl 5 eupl | spdx license identifier eupl 1 [012]
eupl 4 eupl | <under>(?:the )?eupl(?:<l>)?<v>
eupl 3 eupl | eupl(?:<l>| v?1 [012])
eupl 3 union | european union public licen[cs]e<v>
eupl 4 eupl | joinup ec europa eu collection eupl
cecill 5 cecill | spdx license identifier cecill(?: [bc]| [12] [01])
cecill 3 cecill | cecill(?: [bc])?<l><v>
cecill 4 cecill | cecill info licen[cs]es
cecill 3 licence | ce logiciel est régi par la licence
ms-pl 5 ms | spdx license identifier ms pl
ms-pl 3 microsoft | microsoft public<l>
ms-pl 4 opensource | opensource org licenses ms pl
ms-rl 5 ms | spdx license identifier ms rl
ms-rl 3 microsoft | microsoft reciprocal<l>
ms-rl 4 opensource | opensource org licenses ms rl
ms-eula 3 microsoft | microsoft software license terms
odbl 5 odbl | spdx license identifier odbl 1 0
odbl 3 database | open (?:data commons open )?database<l><v>
odbl 4 opendatacommons | opendatacommons org licenses odbl
odc-by 5 odc | spdx license identifier odc by 1 0
odc-by 3 commons | open data commons attribution<l><v>
odc-by 4 opendatacommons | opendatacommons org licenses by
pddl 5 pddl | spdx license identifier pddl 1 0
pddl 3 commons | open data commons public domain dedication(?: and<l>)?<v>
pddl 4 opendatacommons | opendatacommons org licenses pddl
bsl 5 busl | spdx license identifier busl 1 1
bsl 3 business | business source<l><v>
bsl 4 mariadb | mariadb com bsl11
sspl 5 sspl | spdx license identifier sspl 1 0
sspl 3 server | server side public<l><v>
sspl 4 mongodb | mongodb com licensing server side public license
elastic 5 elastic | spdx license identifier elastic 2 0
elastic 3 elastic | elastic<l><v>
elastic 4 elastic | elastic co licensing elastic license
openrail 3 openrail | (?:creativeml |bigscience )?(?:open )?openrail(?: m| rail m)?(?:<l>)?
openrail 3 rail | bigscience rail<l><v>
openrail 3 responsible | responsible ai(?: end user)? licen[cs]es?
llama 3 llama | llama(?: [234])? community<l>(?: agreement)?
aladdin 5 aladdin | spdx license identifier aladdin
aladdin 3 aladdin | aladdin free public<l><v>
nasa 5 nasa | spdx license identifier nasa 1 3
nasa 3 nasa | nasa open source(?:<l>)?(?: agreement)?<v>
intel 5 intel | spdx license identifier intel
intel 3 intel | intel open source<l>
w3c 5 w3c | spdx license identifier w3c
w3c 3 w3c | w3c(?: software)?(?: notice and)?<l>
w3c 4 w3 | w3 org consortium legal copyright software
unicode 5 unicode | spdx license identifier unicode (?:dfs 2016|tou|3 0)
unicode 3 unicode | unicode(?: inc)?<l>(?: agreement)?
unicode 4 unicode | unicode org copyright
vim 5 vim | spdx license identifier vim
vim 3 vim | vim<l>
upl 5 upl | spdx license identifier upl 1 0
upl 3 universal | universal permissive<l><v>
upl 4 upl | oss oracle com licenses upl
ncsa 5 ncsa | spdx license identifier ncsa
ncsa 3 ncsa | (?:university of illinois )?ncsa(?: open source)?<l>
afl 5 afl | spdx license identifier afl [123] [012]
afl 3 academic | academic free<l><v>
osl 5 osl | spdx license identifier osl [123] [01]
osl 3 software | open software<l><v>
qpl 5 qpl | spdx license identifier qpl 1 0
qpl 4 qpl | <under>qpl(?:<l>)?<v>
qpl 4 q | <under>q public(?:<l>)?<v>
qpl 3 qpl | qpl<l><v>
qpl 3 q | q public<l><v>
qpl 2 qpl | licen[cs]e qpl
qpl 2 q | licen[cs]e q public
ipl 5 ipl | spdx license identifier ipl 1 0
ipl 3 ibm | ibm public<l><v>
cpl 5 cpl | spdx license identifier cpl 1 0
cpl 3 common | common public<l><v>
ecl 3 educational | educational community<l><v>
ntp 3 ntp | ntp<l>
curl 5 curl | spdx license identifier curl
libpng 3 libpng | libpng<l><v>
ijg 3 jpeg | based in part on the work of the independent jpeg group
freetype 3 freetype | (?:the )?freetype(?: project)?<l>
lppl 5 lppl | spdx license identifier lppl 1 [0123]c?
lppl 3 latex | latex project public<l><v>
beerware 3 beer | buy me a beer in return
json 3 evil | the software shall be used for good not evil
commons-clause 3 commons | commons clause(?:<l>)? condition v1 0
polyform 3 polyform | polyform (?:noncommercial|small business|shield|strict)<l><v>
sun 3 sun | sun (?:industry standards|public)(?: source)?<l><v>
apsl 3 apple | apple public source<l><v>
rpl 3 reciprocal | reciprocal public<l><v>
ogl 3 government | open government licen[cs]e<v>
public-domain 2 domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain 1 domain | is in the public domain
proprietary 2 proprietary | proprietary and confidential
proprietary 2 unauthorized | unauthorized (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|document|software|material)
all-rights-reserved 1 reserved | all rights reserved
warranty-disclaimer 1 warranty | without warranty of any kind
warranty-disclaimer 1 merchantability | implied warrant(?:y|ies) of merchantability
"""


def rules() -> list[tuple[int, str, str, str, int]]:
    """(number, keyword, pattern, label, priority) in the order in which equal intervals are resolved."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        (label, priority, keyword), pattern = line.partition(" | ")[0].split(), line.partition(" | ")[2]
        for name, piece in PIECES.items():
            pattern = pattern.replace(name, piece)
        out.append((len(out), keyword, f" (?:{pattern})(?= )", label, int(priority)))
    return out


RULES = rules()
GATES = sorted({r[1] for r in RULES})


def _normal(text: Column) -> Column:
    """The words with one space before each and one after the last.

    Letters beyond ASCII may become small too, which no rule or count sees: the two that would turn into
    ASCII letters are replaced before.
    """
    given = F.coalesce(text.cast("string"), F.lit(""))
    for letter in "\u212a\u0130":
        given = F.replace(given, F.lit(letter), F.lit("\u0101"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(given), NOT_WORD, " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _rules_by_keyword() -> Column:
    """A literal map from keywords to their rules; its size is fixed by this file."""
    by_keyword = {k: [{"rule": n, "pattern": p, "label": label, "priority": r} for n, own, p, label, r in RULES if own == k] for k in GATES}
    return F.from_json(F.lit(json.dumps(by_keyword)), "map<string, array<struct<rule: int, pattern: string, label: string, priority: int>>>")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a name of the row, n_words, base places, and for each rule that fits the lengths of its places and of the text before each.

    One pass over the texts without a shuffle, and no text goes on.
    """
    text = column(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    row = F.struct(F.xxhash64(column(id_col), whole).alias("a"), F.xxhash64(whole, column(id_col), F.lit(1)).alias("b"))
    rows = docs.select(column(id_col).alias("doc_id"), row.alias("row"), _normal(text).alias("norm"))
    rows = rows.withColumn("words", F.split("norm", " "))
    rows = rows.withColumn("keys", F.array_intersect("words", F.array(*map(F.lit, GATES))))
    norm = F.col("norm")
    pattern = f" (?:{'|'.join(p for p, _ in BASE)})(?= )"
    parts, found = F.split(norm, pattern, -1), F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))
    label = lambda x: F.coalesce(*[F.when(F.trim(x) == p, F.lit(name)) for p, name in BASE])
    places = F.struct(parts.alias("parts"), found.alias("found"))
    first = _spaces(F.element_at("x.parts", 1))
    last = _spaces(norm) - _spaces(F.element_at("x.parts", -1)) - _spaces(F.element_at("x.found", -1))
    held = [F.contains(norm, F.lit(f" {p} ")) for p, _ in BASE]
    rows = rows.withColumn("x", F.when(held[0] | held[1] | held[2], places))
    chosen = F.flatten(F.transform("keys", lambda k: F.element_at(_rules_by_keyword(), k)))
    fitting = F.filter(chosen, lambda r: F.rlike(norm, r["pattern"]))

    def lengths(r: Column) -> Column:
        pairs = F.arrays_zip(F.split(norm, r["pattern"], -1).alias("p"), F.regexp_extract_all(norm, r["pattern"], F.lit(0)).alias("f"))
        return F.transform(F.filter(pairs, lambda z: z["f"].isNotNull()), lambda z: F.struct(F.length(z["p"]).alias("before"), F.length(z["f"]).alias("size")))

    hits = F.transform(fitting, lambda r: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), lengths(r).alias("places")))
    return rows.select(
        "doc_id", "row", F.when(F.length(norm) > 2, F.size("words") - 2).otherwise(0).cast("long").alias("n_words"),
        F.coalesce(F.size("x.found"), F.lit(0)).cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"),
        F.array_distinct(F.transform("x.found", label)).alias("base_set"), F.when(F.size("keys") > 0, hits).alias("hits"),
    )


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = written(measured(docs, id_col=id_col, text_col=text_col), "license-places")
    # Repeated rows share one name, and their intervals are resolved once.
    once = rows.where("size(hits) > 0").select("row", "hits").dropDuplicates(["row"])
    places = once.select("row", F.explode("hits").alias("h")).select("row", "h.rule", "h.label", "h.priority", F.posexplode("h.places").alias("k", "x"))
    places = places.select("row", "rule", "label", "priority", "k", F.col("x.before").cast("long").alias("before"), F.col("x.size").cast("long").alias("size"))
    so_far = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("size")).over(so_far)
    spans = places.withColumn("end", end).select("row", "rule", "label", "priority", (F.col("end") - F.col("size")).alias("start"), "end")
    # Contained in an interval that starts no later and ends no earlier, of no lower priority.
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[4] for r in RULES})
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in levels}
    covered = F.coalesce(*[F.when(F.col("priority") == p, reach[p] >= F.col("end")) for p in levels])
    kept = spans.withColumn("covered", F.coalesce(covered, F.lit(False))).where("not covered")
    found = kept.groupBy("row").agg(F.collect_set("label").alias("label_set"), F.max("priority").alias("top"))
    none = F.array().cast("array<string>")
    base_set, label_set = F.coalesce("base_set", none), F.coalesce("label_set", none)
    return rows.drop("hits").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_set, label_set)), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("top") / 5.0, F.lit(0.0)), F.when(F.size(base_set) > 0, 0.6).otherwise(0.0)).alias("score"),
    )


__all__ = ["BASE", "GATES", "RULES", "SIGNATURES", "license_scan", "measured", "rules"]
