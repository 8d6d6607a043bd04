r"""License scans (6), in DataFrame functions alone.

A text becomes its words in lower case with one space between. Ordered signature rules (a regular expression, keywords,
priority, label and confidence each) are of two sorts: sentences of licence texts and of the notices that go with them,
written by hand (`TEXTS`), and four forms in which a licence is named, for each family of names. A rule runs where the
text has the words that any of its matches has; a text goes to the rules if it can match any. A detection inside
another one's interval is suppressed if the other has a better priority, or the same one and is longer or comes from
an earlier rule; a containing detection of a worse priority gives way to what it contains only when both name the same
span. The surviving labels and the fixed base phrases' labels are the text's labels.

Words are runs of a-z, 0-9 and anything beyond ASCII; only A-Z is lowered. Places are word numbers from 0.

Results for special cases: null or empty text has no words, places or labels and score 0. Repeated rows give repeated
results. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import whole_text
from .spans import bind, positions, scan

#: The phrases of the base result and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: (words, one of which begins a word in any match; name as words; SPDX identifiers as words).
FAMILIES = {
    "mit": ("mit", r"mit(?: x11| expat)?", r"mit"), "mit-0": ("mit", r"mit(?: no attribution| 0)", r"mit 0"), "x11": ("x11", r"x11", r"x11"), "isc": ("isc", r"isc", r"isc"),
    "apache-1": ("apache", r"apache(?: software)? licen[sc]e(?: version)? 1(?: [01])?|apache 1(?: [01])?", r"apache 1(?: [01])?"),
    "apache-2": ("apache|asl", r"apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?|apache 2(?: 0)?|asl 2(?: 0)?", r"apache 2(?: 0)?"),
    "bsd-2": ("bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause|bsd two clause", r"bsd 2 clause"), "bsd-3": ("bsd", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause|bsd three clause", r"bsd 3 clause"),
    "bsd-4": ("bsd", r"(?:original|4 clause|four clause) bsd|bsd 4 clause", r"bsd 4 clause"), "0bsd": ("bsd|0bsd", r"(?:zero clause|free public) bsd|bsd zero clause|0bsd", r"0bsd"), "bsd": ("bsd", r"bsd(?: style)?", r"bsd"),
    "gpl-1": ("general public|gpl", r"(?:gnu )?(?:general public|gpl)(?: licen[sc]e)?(?: version)? v?1(?: 0)?|gplv1", r"gpl 1 0(?: only| or later)?"), "gpl-2": ("general public|gpl", r"(?:gnu )?(?:general public|gpl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?|gplv2", r"gpl 2 0(?: only| or later)?"),
    "gpl-3": ("general public|gpl", r"(?:gnu )?(?:general public|gpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?|gplv3", r"gpl 3 0(?: only| or later)?"), "gpl": ("general public|gpl", r"gnu general public|(?:gnu )?gpl", r"gpl"),
    "lgpl-2": ("library general public|lgpl", r"(?:gnu )?(?:library general public|lgpl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?|lgplv2", r"lgpl 2 0(?: only| or later)?"), "lgpl-2.1": ("lesser general public|lgpl", r"(?:gnu )?(?:lesser general public|lgpl)(?: licen[sc]e)?(?: version)? v?2 1", r"lgpl 2 1(?: only| or later)?"),
    "lgpl-3": ("lesser general public|lgpl", r"(?:gnu )?(?:lesser general public|lgpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?|lgplv3", r"lgpl 3 0(?: only| or later)?"), "lgpl": ("lesser general public|library general public|lgpl", r"gnu (?:lesser|library) general public|(?:gnu )?lgpl", r"lgpl"),
    "agpl-3": ("affero general public|agpl", r"(?:gnu )?(?:affero general public|agpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?|agplv3", r"agpl 3 0(?: only| or later)?"), "agpl": ("affero general public|agpl", r"gnu affero general public|(?:gnu )?agpl", r"agpl"), "gfdl": ("gnu free|gfdl", r"gnu free documentation|gfdl", r"gfdl(?: 1 [123])?"),
    "mpl-1": ("mozilla public|mpl", r"(?:mozilla public|mpl)(?: licen[sc]e)?(?: version)? 1(?: [01])?", r"mpl 1 [01]"), "mpl-2": ("mozilla public|mpl", r"(?:mozilla public|mpl)(?: licen[sc]e)?(?: version)? 2(?: 0)?", r"mpl 2 0"), "mpl": ("mozilla public|mpl", r"mozilla public|mpl", r"mpl"),
    "epl-1": ("eclipse public|epl", r"(?:eclipse public|epl)(?: licen[sc]e)?(?: version)? 1(?: 0)?", r"epl 1 0"), "epl-2": ("eclipse public|epl", r"(?:eclipse public|epl)(?: licen[sc]e)?(?: version)? 2(?: 0)?", r"epl 2 0"), "epl": ("eclipse public|epl", r"eclipse public", r"epl"), "edl-1": ("eclipse distribution|edl", r"eclipse distribution", r"edl 1 0"),
    "cddl-1": ("common development|cddl", r"(?:common development and distribution|cddl)(?: licen[sc]e)?(?: version)?(?: 1(?: [01])?)?", r"cddl 1 [01]"), "cpl-1": ("common public|cpl", r"common public", r"cpl 1 0"), "cpal": ("common public|cpal", r"common public attribution", r"cpal 1 0"), "ipl": ("ibm|ipl", r"ibm public", r"ipl 1 0"),
    "eupl": ("european union|eupl", r"(?:european union public|eupl)(?: licen[sc]e)?(?: version)?(?: 1 [012])?", r"eupl 1 [012]"), "artistic-1": ("artistic", r"artistic(?: licen[sc]e)?(?: version)? 1(?: 0)?", r"artistic 1 0"), "artistic-2": ("artistic", r"artistic(?: licen[sc]e)?(?: version)? 2(?: 0)?", r"artistic 2 0"), "artistic": ("artistic", r"artistic", r"artistic"),
    "boost": ("boost|bsl", r"boost software", r"bsl 1 0"), "zlib": ("zlib", r"zlib(?: libpng)?", r"zlib"), "libpng": ("libpng", r"libpng", r"libpng(?: 2 0)?"), "curl": ("curl", r"curl", r"curl"), "unlicense": ("unlicense", r"unlicense", r"unlicense"), "wtfpl": ("wtfpl|do what the f", r"wtfpl|do what the f\w+ you want to public", r"wtfpl"),
    "python": ("python|psf", r"python software foundation|psf", r"(?:psf|python) 2 0"), "ruby": ("ruby", r"ruby", r"ruby"), "php": ("php", r"php(?: licen[sc]e)?(?: version)?(?: 3(?: 0[01])?)?", r"php 3 0[01]?"), "perl": ("perl", r"perl", r"perl"), "tcl": ("tcl", r"tcl(?: tk)?", r"tcl"), "zpl": ("zope|zpl", r"zope public", r"zpl [12] [01]"), "openssl": ("openssl", r"openssl", r"openssl"),
    "ofl": ("open font|ofl", r"(?:sil )?open font|ofl", r"ofl 1 [01]"), "postgresql": ("postgresql", r"postgresql", r"postgresql"), "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa"), "w3c": ("w3c", r"w3c(?: software)?", r"w3c"), "unicode": ("unicode", r"unicode(?: inc)?", r"unicode(?: dfs 201[56])?"), "icu": ("icu", r"icu", r"icu"),
    "osl": ("open software|osl", r"open software", r"osl [123] [01]"), "afl": ("academic|afl", r"academic free", r"afl [123] [012]"), "ecl": ("educational|ecl", r"educational community", r"ecl [12] 0"), "ms-pl": ("microsoft public|ms pl", r"microsoft public|ms pl", r"ms pl"), "ms-rl": ("microsoft reciprocal|ms rl", r"microsoft reciprocal|ms rl", r"ms rl"), "odbl": ("open data|odbl", r"open (?:data commons open )?database|odbl", r"odbl 1 0"),
    "odc-by": ("open data|odc", r"open data commons attribution", r"odc by 1 0"), "pddl": ("public domain|pddl", r"public domain dedication and|pddl", r"pddl 1 0"), "cecill": ("cecill", r"cecill(?: [abc])?(?: 2(?: [01])?)?", r"cecill(?: [abc12])?(?: [01])?"), "qpl": ("q public|qpl", r"q public|qpl", r"qpl 1 0"), "sleepycat": ("sleepycat", r"sleepycat", r"sleepycat"), "vim": ("vim", r"vim", r"vim"),
    "apple": ("apple|apsl", r"apple public source", r"apsl 2 0"), "nasa": ("nasa", r"nasa open source", r"nasa 1 3"), "nokia": ("nokia", r"nokia open source", r"nokia"), "sun": ("sun|spl|sissl", r"sun (?:public|industry standards source)", r"(?:spl 1 0|sissl)"), "intel": ("intel", r"intel open source|intel simplified software", r"intel"), "netscape": ("netscape|npl", r"netscape public", r"npl 1 [01]"),
    "upl": ("universal permissive|upl", r"universal permissive|upl", r"upl 1 0"), "elastic": ("elastic", r"elastic licen[sc]e(?: version)? 2(?: 0)?|elastic 2 0", r"elastic 2 0"), "sspl": ("server side|sspl", r"server side public|sspl", r"sspl 1 0"), "busl": ("business|busl", r"business source", r"busl 1 1"), "commons-clause": ("commons", r"commons clause", r"commons clause"), "polyform": ("polyform", r"polyform (?:noncommercial|small business|shield)", r"polyform \w+ 1 0 0"),
    "blueoak": ("blue oak|blueoak", r"blue oak model", r"blueoak 1 0 0"), "hippocratic": ("hippocratic", r"hippocratic", r"hippocratic 2 1"), "json": ("json", r"json", r"json"), "beerware": ("beer", r"beer ?ware", r"beerware"), "fair": ("fair", r"fair", r"fair"), "mulan": ("mulan", r"mulan (?:permissive software|psl)(?: v?[12])?", r"mulanpsl [12] 0"), "openrail": ("rail|open rail|openrail|creativeml|bigscience", r"(?:creativeml |bigscience )?open ?rail(?: m)?", r"openrail(?: m)?"),
    "llama": ("llama", r"llama(?: [23])?(?: community)?", r"llama\w*"), "cc0": ("cc|creative commons", r"cc ?0(?: 1 0)?|creative commons zero", r"cc0 1 0"), "public-domain": ("public domain", r"public domain", r"public domain"),
    **{f"cc-{'-'.join(p)}": ("cc", rf"cc {' '.join(p)}(?: [1234](?: 0)?)?", rf"cc {' '.join(p)}(?: [1234](?: 0)?)?") for p in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))},
}
#: Names that the label above has as well.
CREATIVE = {"cc-by": "", "cc-by-sa": " share ?alike", "cc-by-nd": " no ?deriv\\w+", "cc-by-nc": " non ?commercial", "cc-by-nc-sa": " non ?commercial share ?alike", "cc-by-nc-nd": " non ?commercial no ?deriv\\w+"}
#: Sentences of licence texts and notices, by hand: label, words that any match has, expression. `~` is up to eight words.
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software|material|work|font software)(?: and associated documentation files?)?"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice(?: including the next paragraph)? (?:shall|must) be included in all copies or substantial portions of the (?:software|materials?)"),
    ("mit", "to deal", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit", "mit style", r"(?:use of )?this source code is governed by an? mit style"),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted ~ to deal in the software without restriction ~ and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "except as contained in this notice", r"except as contained in this notice the names? of ~ shall not be used in advertising or otherwise to promote the sale"),
    ("x11", "x consortium", r"x consortium is a trademark of"),
    ("isc", "with or without fee", r"permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted"),
    ("isc", "loss of use data or profits", r"special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify(?: and)?(?: distribute| sell| and)* this software and its documentation for any purpose(?: is hereby granted)? without fee"),
    ("hpnd", "supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("0bsd", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that)?(?: the following conditions are met)?"),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice(?: this list of conditions)?"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3", "endorse or promote", r"neither the names? of ~ (?:nor|or) ~ (?:contributors|authors?)(?: ~)? may be used to endorse or promote products derived from this software"),
    ("bsd-3", "endorse or promote", r"the names? of ~ may not be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-3", "bsd style", r"(?:use of )?this source code is governed by an? bsd style licen[sc]e"),
    ("apache-2", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", "www apache org", r"(?:https? )?www apache org licen[sc]es(?: licen[sc]e)? 2 0"),
    ("apache-2", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution"),
    ("apache-2", "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2", "perpetual worldwide", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-1", "software developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-2", "either version 2", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2"),
    ("gpl-2", "general public", r"under the terms of the gnu general public licen[sc]e(?: version 2 only)?(?: as published by the free software foundation)? version 2(?: only)?"),
    ("gpl-3", "either version 3", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3"),
    ("gpl-3", "29 june 2007", r"gnu general public licen[sc]e version 3 29 june 2007"),
    ("gpl-2", "june 1991", r"gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-1", "february 1989", r"gnu general public licen[sc]e version 1 february 1989"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("gpl", "general public", r"you should have received a copy of the gnu general public licen[sc]e(?: along with)?"),
    ("gpl", "redistribute it", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "take away your freedom", r"the licen[sc]es for most software(?: and other practical works)? are designed to take away your freedom"),
    ("lgpl-2.1", "either version 2 1", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1"),
    ("lgpl-2", "either version 2", r"under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2"),
    ("lgpl-3", "either version 3", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3"),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl", "general public", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "redistribute it", r"this library is free software you can redistribute it and or modify it"),
    ("agpl-3", "affero", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3"),
    ("agpl-3", "19 november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public licen[sc]e"),
    ("gpl-classpath", "linking this", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gfdl", "invariant sections", r"with (?:no|the) invariant sections(?: being ~)?(?: with)?(?: no| the)? front cover texts"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-2", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[sc]e(?: v 2 0| version 2 0)?"),
    ("mpl-2", "mozilla org", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1(?: [01])?"),
    ("mpl-2", "incompatible with secondary", r"this source code form is incompatible with secondary licen[sc]es"),
    ("npl", "netscape public", r"the contents of this file are subject to the netscape public licen[sc]e"),
    ("epl-2", "eclipse public", r"made available under the terms of the eclipse public licen[sc]e(?: v| version)? ?2(?: 0)?"),
    ("epl-1", "eclipse public", r"made available under the terms of the eclipse public licen[sc]e v(?:ersion )?1(?: 0)?"),
    ("edl-1", "eclipse distribution", r"made available under the terms of the eclipse distribution licen[sc]e"),
    ("cddl-1", "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-1", "common public", r"the accompanying program is provided under the terms of this common public licen[sc]e"),
    ("epl", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
    ("artistic", "perl itself", r"(?:is free software )?you (?:can|may) redistribute it and or modify it under the same terms as perl itself"),
    ("artistic-1", "under which a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "free software package", r"this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed"),
    ("boost", "person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", "boost org", r"(?:https? )?www boost org licen[sc]e 1 0"),
    ("zlib", "held liable", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png reference library", r"the png reference library is supplied as is"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", r"(?:https? )?unlicense org"),
    ("wtfpl", "what the f", r"(?:you )?just do what the f\w+ you want to"),
    ("beerware", "buy me a beer", r"(?:if we meet some day ~ )?you can buy me a beer in return"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("postgresql", "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "with the software", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("curl", "daniel stenberg", r"copyright(?: c)? (?:\d+ )+daniel stenberg"),
    ("openssl", "software developed by the openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("python", "python software foundation", r"(?:copyright ~ )?python software foundation all rights reserved"),
    ("python", "psf", r"psf is making python available to licensee on an as is basis"),
    ("ruby", "redistribute it and or modify it", r"you (?:can|may) redistribute it and or modify it under (?:either )?(?:the )?(?:terms of )?(?:the )?(?:same terms as ruby|ruby s licen[sc]e)"),
    ("php", "product includes php", r"this product includes php software freely available from"),
    ("zpl", "zope", r"subject to the provisions of the zope public licen[sc]e"),
    ("vim", "unmodified copies of vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", "authors hereby grant", r"the authors hereby grant permission to use copy modify distribute and licen[sc]e this software"),
    ("ofl", "font software", r"this font software is licen[sc]ed under the sil open font licen[sc]e"),
    ("ofl", "reserved font name", r"with reserved font names?"),
    ("ofl", "stimulate worldwide", r"the goals of the open font licen[sc]e ofl are to stimulate worldwide development"),
    ("unicode", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode data files|data files)"),
    ("w3c", "you the licensee agree", r"by obtaining(?: using and or copying)? this work you the licensee agree"),
    ("osl", "open software", r"licen[sc]ed under the open software licen[sc]e version \d 0"),
    ("afl", "academic free", r"licen[sc]ed under the academic free licen[sc]e version \d [01]"),
    ("ms-pl", "use of the accompanying software", r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("eupl", "under the eupl", r"licen[sc]ed under the eupl(?: version| v)? ?1 [12]"),
    ("eupl", "you may not use this work", r"you may not use this work except in compliance with the licen[sc]e"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? licen[sc]e"),
    ("odbl", "open database", r"this ~ is made available under the open database licen[sc]e"),
    ("pddl", "public domain dedication", r"this ~ is made available under the public domain dedication and licen[sc]e"),
    ("cc0", "to the extent possible under law", r"to the extent possible under law ~ has waived all copyright and related or neighbou?ring rights"),
    ("cc0", "dedicated the work", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "publicdomain zero", r"(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public domain", r"(?:this (?:file|work|software|code|program) (?:is|has been|was) )?(?:hereby )?(?:placed|released|put|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "author disclaims copyright", r"the author disclaims copyright to this source code"),
    ("cc-by", "creativecommons org", r"(?:https? )?creativecommons org licen[sc]es by \d \d"),
    ("cc-by-sa", "creativecommons org", r"(?:https? )?creativecommons org licen[sc]es by sa \d \d"),
    ("cc-by-nd", "creativecommons org", r"(?:https? )?creativecommons org licen[sc]es by nd \d \d"),
    ("cc-by-nc", "creativecommons org", r"(?:https? )?creativecommons org licen[sc]es by nc \d \d"),
    ("cc-by-nc-sa", "creativecommons org", r"(?:https? )?creativecommons org licen[sc]es by nc sa \d \d"),
    ("cc-by-nc-nd", "creativecommons org", r"(?:https? )?creativecommons org licen[sc]es by nc nd \d \d"),
    ("upl", "each a larger work", r"each a larger work to which the software is contributed"),
    ("elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "third parties as a service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "non production use", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl", "fourth anniversary of the first", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("commons-clause", "right to sell", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software"),
    ("polyform", "noncommercial purpose", r"any noncommercial purpose is a permitted purpose"),
    ("blueoak", "protecting contributors", r"everyone ~ as much permission to work with this software as possible while protecting contributors"),
    ("openrail", "derivatives of the model", r"you agree not to use the model or derivatives of the model"),
    ("llama", "under the llama", r"llama \d(?: \d)? is licen[sc]ed under the llama"),
    ("hippocratic", "human rights", r"the software (?:shall|must) not be used ~ (?:violate|infringe)\w* ~ human rights"),
    ("mulan", "software according to the terms", r"you can use this software according to the terms and conditions of the mulan psl"),
    ("proprietary", "confidential and proprietary", r"(?:this (?:software|document|file|source code) (?:is|contains) )?(?:the )?confidential and proprietary(?: information)?"),
    ("proprietary", "proprietary and confidential", r"(?:this (?:software|document|file|source code) (?:is|contains) )?(?:the )?proprietary and confidential(?: information)?"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|duplication)(?: of this (?:file|software|code))?(?: ~)? (?:is )?(?:strictly )?(?:prohibited|forbidden)"),
    ("proprietary", "prior written", r"may not be (?:copied|reproduced|distributed|disclosed) ~ without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", "all rights reserved", r"copyright ~ all rights reserved"),
    ("freeware", "freeware", r"this (?:software|program) is (?:distributed as )?freeware"),
    ("shareware", "shareware", r"this (?:software|program) is (?:distributed as )?shareware"),
    ("non-commercial", "non commercial use only", r"for (?:personal and )?non commercial use only"),
    ("non-commercial", "free for", r"free for (?:personal|non commercial|private) use"),
    ("research-only", "research purposes", r"for (?:academic|non commercial) (?:and )?research purposes only"),
    ("export", "export", r"(?:this (?:software|product) )?(?:is|may be) subject to (?:u s|us|united states) export (?:control )?(?:laws|regulations)"),
]
VERBS = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|made available|redistributed?|offered|governed)"
WORD = r"licen[sc]es?"
TERMS = r"under (?:the )?terms (?:and conditions )?of (?:the )?(?:a |an )?"
NOTICE = r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:a |an )?"
#: Families whose names are ordinary words or those of programs as well; and such names of other families.
COMMON = set("artistic curl ruby php perl tcl vim json fair unicode icu x11 llama".split())
ORDINARY = set("afl ecl osl cpl-1 cpal ipl edl-1 boost busl nokia nasa apple intel netscape upl sun".split())  # unfinished titles
COMMON_NAMES = {"python": "python", "elastic": "elastic", "openrail": "rail"}
#: Families whose names stand for a licence and nothing else, so that "under NAME" is enough.
PLAIN = ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "apache-", "bsd-", "0bsd", "cc-", "cc0", "cddl", "eupl", "unlicense", "wtfpl", "cecill", "mit-0")
VERSION = r"(?:version \d+|v?\d+)(?: \d+)?"
#: Families with names that say enough without a notice.
MENTIONED = ("cc-", "cc0", "gpl-", "lgpl-", "agpl-", "apache-", "mpl-", "epl-")
#: What every match of a form of rules has.
NEEDS = {"identifier": "licen", "notice": " under ", "named": "licen", "mention": " "}
PRIORITIES = (1, 2, 3, 4, 9)


def noticed(name: str, label: str, common: bool) -> str:
    """"under NAME" with what shows that a licence is meant: a verb, its terms, the word licence or a version; for names
    that are common words a verb with one of the latter two, or more of a licence's title."""
    title = rf"(?:{name})(?: (?:open source |public |software |international )?{WORD})"
    if common:
        return rf"{VERBS} {NOTICE}(?:{title}(?: {VERSION})?|(?:{name}) {VERSION})|{NOTICE}(?:{name}) (?:open source |public |software |international ){WORD}(?: {VERSION})?"
    if label.startswith(PLAIN):
        return rf"(?:{VERBS} )?{NOTICE}{title}?(?: {VERSION})?"
    if label in ORDINARY:
        return rf"(?:{VERBS} )?{NOTICE}(?:{title}(?: {VERSION})?|(?:{name}) {VERSION})"
    return rf"{VERBS} {NOTICE}{title}?(?: {VERSION})?|{NOTICE}(?:{title}(?: {VERSION})?|(?:{name}) {VERSION})|{TERMS}{title}?(?: {VERSION})?"


def named(name: str, common: bool) -> str:
    """The name with the word licence; of common words with more of its title, or a version."""
    more = "(?:open source |public |software |general public |international )"
    return rf"(?:the )?(?:{name}) (?:{more}{WORD}|{WORD} {VERSION})" if common else rf"(?:the )?(?:{name}) {more}?{WORD}"


def rules() -> list[dict]:
    """All signature rules in their order: texts, identifiers, notices, named licences, and plain names."""
    found = [{"label": label, "need": " ", "keys": [keyword], "regex": regex.replace("~", r"(?:\S+ ){0,7}\S+"), "priority": 1, "confidence": 0.95} for label, keyword, regex in TEXTS]
    names = [(label, keyword, name, spdx, label in COMMON) for label, (keyword, name, spdx) in FAMILIES.items()] + [(label, name, name, None, True) for label, name in COMMON_NAMES.items()]
    for form in ("identifier", "notice", "named", "mention"):
        for label, keyword, name, spdx, common in names:
            regex = {
                "identifier": spdx and (rf"(?:spdx licen[sc]e identifier|licen[sc]e identifier|licen[sc]e) (?:{spdx})" if " " in spdx or label in ("mit", "isc", "unlicense") else rf"spdx licen[sc]e identifier (?:{spdx})"),
                "notice": noticed(name, label, common),
                "named": named(name, common),
                "mention": name if label.startswith(MENTIONED) else None,
            }[form]
            if regex:
                found.append({"label": label, "need": NEEDS[form], "keys": keyword.split("|"), "regex": regex, "priority": {"identifier": 1, "notice": 2, "named": 3, "mention": 4}[form], "confidence": {"identifier": 1.0, "notice": 0.95, "named": 0.85, "mention": 0.6}[form]})
    for label, words in CREATIVE.items():
        found.append({"label": label, "need": " ", "keys": ["creative commons"], "regex": rf"creative commons attribution{words}(?: (?:licen[sc]e|international|unported|generic|[1234] 0))*", "priority": 2, "confidence": 0.95})
    found.append({"label": "proprietary", "need": " ", "keys": ["all rights reserved"], "regex": "all rights reserved", "priority": 4, "confidence": 0.4})
    found.append({"label": "unknown", "need": "licen", "keys": ["licen"], "regex": rf"(?:\S+ ){{1,3}}?(?:public|open|source|software|community|free|permissive|model) licen[sc]e (?:version \d+|v\d+)(?: \d+)?", "priority": 9, "confidence": 0.3})
    found.append({"label": "unknown", "need": " under ", "keys": ["licen"], "regex": rf"{VERBS} under (?:the )?(?:terms of )?(?:the |a |an )?(?:\S+ ){{1,4}}?{WORD}", "priority": 9, "confidence": 0.3})
    return [r | {"rank": n, "regex": f"(?<= )(?:{r['regex']})(?= )"} for n, r in enumerate(found)]


def shortest(keys: Iterable[str]) -> dict[str, str]:
    """For each key the shortest one that it begins with: of those no one begins another."""
    out: dict[str, str] = {}
    for key in sorted(set(keys)):
        last = next(reversed(out.values()), None)
        out[key] = last if last and key.startswith(last) else key
    return out


def either(keys: Iterable[str]) -> str:
    """An expression for any of some keys that no one of them begins another, shared beginnings once."""
    by: dict[str, list[str]] = {}
    for key in sorted(set(keys)):
        by.setdefault(key[:1], []).append(key[1:])
    return "(?:" + "|".join(first + (either(rest) if len(rest) > 1 else rest[0]) for first, rest in by.items()) + ")"


def may_match(words: Column) -> Column:
    """Whether any rule or base phrase can match: the words of a text rule, the stem of license, or a name in the forms without it."""
    names = "|".join([*(name for _, name, _ in FAMILIES.values()), *COMMON_NAMES.values()])
    mentioned = "|".join(name for label, (_, name, _) in FAMILIES.items() if label.startswith(MENTIONED))
    said = either(shortest([*(k for _, k, _ in TEXTS), "creative commons attribution"]).values())
    stems = either(shortest(k for label, (keys, _, _) in FAMILIES.items() if label.startswith(MENTIONED) for k in keys.split("|")).values())
    return F.contains(words, F.lit("licen")) | words.rlike(f" {said}") | words.rlike(f" {NOTICE}(?:{names}) ") | (words.rlike(f" {stems}") & words.rlike(f" (?:{mentioned}) "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def canonical(text: Column) -> Column:
    """' word word word ', or '  ' without words; A-Z lowered."""
    others = "".join(chr(n) for n in range(128) if not chr(n).isalnum() and n != 32)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, others + upper, " " * len(others) + upper.lower()), "  +", " ")), F.lit(" "))


def detections(words: Column) -> Column:
    """array<struct<start, end, priority, rank, label, confidence>> of all rules, before suppression.

    One pass finds the keys that begin a word; only rules with one of them, and with what their form needs, run.
    """
    every = rules()
    key_of = shortest(k for r in every for k in r["keys"])
    ranks: dict[str, list[int]] = {}
    for r in every:
        for k in {key_of[k] for k in r["keys"]}:
            ranks.setdefault(k, []).append(r["rank"])
    kept = ("label", "need", "regex", "priority", "confidence", "rank")
    table = F.from_json(F.lit(json.dumps([{c: r[c] for c in kept} for r in every])), "array<struct<label:string,need:string,regex:string,priority:int,confidence:double,rank:int>>")
    by_key = F.from_json(F.lit(json.dumps(ranks)), "map<string,array<int>>")
    keys = F.array_distinct(F.regexp_extract_all(words, F.lit(f" (?=({either(ranks)}))"), F.lit(1)))
    candidates = F.array_sort(F.array_distinct(F.flatten(F.transform(keys, lambda k: F.element_at(by_key, k)))))

    def of(rule: Column) -> Column:
        return F.transform(positions(words, rule["regex"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), *(rule[c].alias(c) for c in ("priority", "rank", "label", "confidence"))))

    return F.flatten(F.transform(F.filter(F.transform(candidates, lambda n: F.get(table, n)), lambda r: F.contains(words, r["need"])), of))


def surviving(found: Column) -> Column:
    """Without the detections that another one's interval contains and outranks.

    In the order of start, longer, better priority, earlier rule, whatever may suppress a detection stands before it; it
    is suppressed if any of those with its priority or a better one reaches its end.
    """
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), *(s[c].alias(c) for c in ("priority", "rank", "label", "confidence")))))

    def kept(spans: Column) -> Column:
        def ends(least: int) -> Column:
            return F.transform(spans, lambda s: F.when(s["priority"] <= least, -s["back"]).otherwise(F.lit(0)))

        reach = F.array(*(scan(ends(p), lambda a, b: F.greatest(a, b)) for p in PRIORITIES))

        def judged(reached: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                before = F.get(F.get(reached, F.array_position(F.array(*map(F.lit, PRIORITIES)), s["priority"]).cast("int") - 1), i - 1)
                out = F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), *(s[c].alias(c) for c in ("priority", "rank", "label", "confidence")))
                return F.when((i == 0) | (before < -s["back"]), out)

            return F.filter(F.transform(spans, one), lambda s: s.isNotNull())

        return bind(reach, judged)

    return bind(ordered, kept)


def scan_licenses(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, found (surviving detections, start and end in characters
    of the canonical words), labels, score."""
    plain = docs.select(F.col(id_column).alias("id"), canonical(whole_text(text)).alias("words"))
    plain = plain.withColumn("n_words", F.when(F.col("words") == "  ", F.lit(0)).otherwise(spaces(F.col("words")) - 1).cast("long"))
    gated = plain.withColumn("words", F.when(may_match(F.col("words")), F.col("words")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        parts = F.split("words", f"(?<= ){phrase}(?= )", -1)
        places = F.when(F.contains("words", F.lit(f" {phrase} ")), F.size(parts) - 1).otherwise(F.lit(0))
        counts.append(places)
        firsts.append(F.when(places > 0, spaces(F.element_at(parts, 1)) - 1))
        lasts.append(F.when(places > 0, F.col("n_words") - (spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        labels.append(F.when(places > 0, F.lit(label)))
    none = F.expr("cast(array() as array<struct<start:int,end:int,priority:int,rank:int,label:string,confidence:double>>)")
    found = F.when(F.col("words").isNotNull(), bind(detections(F.col("words")), lambda all_: F.when(F.size(all_) > 0, surviving(all_)).otherwise(none))).otherwise(none)
    out = gated.select(
        "id", "n_words", sum(counts, F.lit(0)).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.filter(F.array(*labels), lambda x: x.isNotNull())).alias("base"), found.alias("found"),
    )
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("found", lambda s: s["confidence"])), F.lit(0.0))
    score = F.greatest(best, F.when(F.col("n_base") > 0, 0.9).otherwise(0.0))
    return out.select(F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), "found", F.array_join(every, ",").alias("labels"), score.alias("score"))
