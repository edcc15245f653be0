"""The ordered signature rules of the license scan.

A rule is a regular expression over words that are lower-cased and joined by one space. Rules of passages and headers are
written one by one; those of names are each license's own expressions set into the phrases in which licenses are declared.
"""

import re
from dataclasses import dataclass

#: Kinds in order of priority, with the score of a detection.
KINDS = {"text": 1.0, "tag": 0.95, "notice": 0.9, "link": 0.85, "name": 0.7, "mention": 0.4}


@dataclass(frozen=True)
class Rule:
    kind: str
    label: str
    pattern: str
    #: Words that stand in every match: a text without them isn't searched.
    keywords: tuple[str, ...]


# Licenses (label; keywords; expressions of the name with version; expression of the SPDX identifier as words).
LICENSES = [
    ("apache-2.0", "apache", r"apache (?:software )?(?:license )?(?:version |v )?(?:2 0|v2 0|2|v2)(?: license)?|apache license(?: \w+){0,2} 2 0", "apache 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v )?1 1", "apache 1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?license (?:version |v )?1 0", "apache 1 0"),
    ("mit", "mit", r"mit (?:x11 |expat )?(?:style )?licen[sc]es?|mit x11", "mit"),
    ("x11", "x11", r"x11 (?:style )?licen[sc]e", "x11"),
    ("isc", "isc", r"isc (?:style )?licen[sc]e", "isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd (?:style )?licen[sc]e|bsd (?:2|two) clause(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd (?:style )?licen[sc]e|bsd (?:3|three) clause(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4 clause|four clause) bsd (?:style )?licen[sc]e|bsd (?:4|four) clause(?: licen[sc]e)?", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[sc]e)?", "0bsd"),
    ("gpl-1.0", "gpl", r"gpl ?(?:version |v)?1(?: 0)?(?: only| or later)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"gpl (?:version |v )?2(?: 0)?(?: only| or later)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl (?:version |v )?3(?: 0)?(?: only| or later)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: only| or later)?", "gplv2"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: only| or later)?", "gplv3"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:version |v |v)2(?: 0)?", "gnu gpl 2 0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:version |v |v)3(?: 0)?", "gnu gpl 3 0"),
    ("lgpl-2.0", "lgpl", r"lgpl (?:version |v )?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl (?:version |v )?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"lgpl (?:version |v )?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1", "gnu lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?", "gnu lgpl 3 0"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[sc]e(?: (?:version |v )?2(?: 0)?)?", "gnu lgpl 2 0"),
    ("agpl-3.0", "agpl", r"agpl (?:version |v )?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v )?3(?: 0)?)?", "gnu agpl 3 0"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[sc]e(?: (?:version |v )?1 [123])?", "gfdl 1 3(?: only| or later)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: (?:version |v )?2 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v )?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: (?:version |v )?2 0)?", "epl 2 0"),
    ("cddl-1.0", "cddl", r"cddl (?:version |v )?1 0", "cddl 1 0"),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: (?:version |v )?1 0)?", "cpl 1 0"),
    ("eupl-1.2", "european", r"european union public licen[sc]e(?: (?:version |v )?1 [12])?", "eupl 1 2"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: (?:version |v )?2 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v )?1 0)?", "bsl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: (?:version |v )?2)?", "wtfpl"),
    ("python-2.0", "python", r"python software foundation licen[sc]e(?: (?:version |v )?2(?: 0)?)?", "python 2 0"),
    ("php-3.01", "php", r"php licen[sc]e (?:version |v )?3 01", "php 3 01"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl"),
    ("ofl-1.1", "sil", r"sil open font licen[sc]e(?: (?:version |v )?1 1)?", "ofl 1 1"),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database licen[sc]e(?: (?:version |v )?1 0)?", "odbl 1 0"),
    ("pddl-1.0", "pddl", r"pddl(?: (?:version |v )?1 0)?", "pddl 1 0"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-1.0", "cc", r"cc by 1 0", "cc by 1 0"),
    ("cc-by-2.0", "cc", r"cc by 2 0", "cc by 2 0"),
    ("cc-by-3.0", "cc", r"cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc", r"cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?", "creative commons by"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?", "creative commons by sa"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?", "creative commons by nc"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?", "creative commons by nd"),
]

# Passages of license texts and of the headers that licenses prescribe (label; keywords; expression).
PASSAGES = [
    ("mit", "permission hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd-3-clause", "endorse promote products", r"neither the name of (?:\S+ ){1,16}(?:nor the names of its contributors )?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "redistributions source conditions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions binary conditions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2.0", "apache license file", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "asf contributor license", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "redistribute modify general", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "redistribute modify general", r"(?:this|it) (?:\S+ ){0,4}is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute modify lesser", r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "redistribute modify affero", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "hope useful warranty", r"is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "received copy gnu", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "received copy lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("mpl-2.0", "source mozilla terms", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents mozilla subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "accompanying eclipse available", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", "unencumbered public domain", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "express implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("wtfpl", "everyone permitted verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("bsl-1.0", "boost distributed software", r"distributed under the boost software license version 1 0"),
    ("cc0-1.0", "dedicated public domain", r"(?:has|have) dedicated (?:the|this) work to the public domain by waiving"),
    ("public-domain", "placed public domain", r"(?:is|are|been) (?:hereby )?(?:placed|put|released) (?:in|into) the public domain"),
    ("ofl-1.1", "font licensed sil", r"this font software is licensed under the sil open font license"),
    ("gfdl", "documentation permission granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("cc-by", "creative commons licensed", r"this work is licensed under (?:a|the) creative commons attribution (?:[1-4] [05] )?(?:international |unported )?license"),
    ("cc-by-sa", "creative commons licensed", r"this work is licensed under (?:a|the) creative commons attribution share ?alike (?:[1-4] [05] )?(?:international |unported )?license"),
    ("proprietary", "unauthorized copying prohibited", r"unauthorized (?:copying|use|reproduction|distribution)(?: \S+){0,8} (?:is |are )?(?:strictly )?prohibited"),
    ("proprietary", "confidential proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "reproduced written permission", r"(?:may|must) not be (?:reproduced|copied|redistributed)(?: \S+){0,12} without (?:\S+ ){0,4}(?:written )?permission"),
]

# Addresses of license texts as words (label; keywords; expression).
LINKS = [
    ("apache-2.0", "apache licenses", r"www apache org licenses license 2 0"),
    ("mit", "opensource mit", r"opensource org licenses? mit"),
    ("gpl", "gnu licenses", r"www gnu org (?:licenses|copyleft)(?: gpl(?: html)?)?"),
    ("mpl-2.0", "mozilla mpl", r"(?:www )?mozilla org (?:en us )?mpl(?: 2 0)?"),
    ("cc-by", "creativecommons by", r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons sa", r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons nc", r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons nc sa", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons nd", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc0-1.0", "creativecommons publicdomain", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("epl-2.0", "eclipse epl", r"www eclipse org legal epl (?:2 0|v20)"),
    ("unlicense", "unlicense org", r"unlicense org"),
]

# Names without a version and other mentions (label; keywords; expression).
MENTIONS = [
    ("apache", "apache", r"apache licen[sc]e"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]es?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl", "gnu general", r"gnu general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl"),
    ("cddl-1.0", "development distribution", r"common development and distribution licen[sc]e"),
    ("creative-commons", "creative commons", r"creative commons(?: licen[sc]es?)?"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "proprietary", r"proprietary (?:software )?licen[sc]e"),
    ("commercial", "commercial", r"commercial licen[sc]e"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("permission", "reprinted", r"reprinted (?:with|by) (?:kind )?permission"),
    ("open-source", "open source", r"open source licen[sc]e"),
    ("permissive", "permissive", r"permissive licen[sc]e"),
    ("copyleft", "copyleft", r"copyleft"),
]

#: How a notice names its license, and how a tag does (fixed values): words that must be there, and the phrase.
NOTICES = [("under", r"(?:licen[sc]ed|released|distributed|published|available|provided|shared|covered|redistributed|offered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{}"), ("subject", r"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{}")]
TAGS = [("license", r"(?:spdx )?license(?: identifier)? {}")]


def rules() -> list[Rule]:
    """All rules in the order in which they are tried: by kind, then those with more words in their expression, then as written."""
    found = [Rule("text", label, pattern, tuple(words.split())) for label, words, pattern in PASSAGES]
    found += [Rule("link", label, pattern, tuple(words.split())) for label, words, pattern in LINKS]
    found += [Rule("mention", label, pattern, tuple(words.split())) for label, words, pattern in MENTIONS]
    for label, words, name, tag in LICENSES:
        own = tuple(words.split())
        found += [Rule("notice", label, phrase.format(f"(?:{name})"), (*own, word)) for word, phrase in NOTICES]
        needed = tuple(w for w in tag.split(" ") if re.fullmatch("[a-z0-9]{2,}", w))
        found += [Rule("tag", label, phrase.format(tag), (*needed, word)) for word, phrase in TAGS]
        found.append(Rule("name", label, name, own))
    order = list(KINDS)
    return sorted(found, key=lambda r: (order.index(r.kind), -r.pattern.count(" ")))
