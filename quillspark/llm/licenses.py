"""Operator 10: license scans by ordered signature rules (native: DataFrame functions only).

A rule is (name, label, priority, confidence, keywords joined by |, regular expression). Rules are written by hand: the
sentences of license texts and notices, and for each license family its name in running text, its SPDX identifier, its
address and a grant sentence. A document is looked at only if it holds a gate word; a rule runs only if the document
holds one of its keywords; both are looked for with white space squeezed, as wrapped texts break phrases. Detections are
intervals; one that lies within a kept one of the same or a stronger priority is suppressed, and the labels of the rest
are reported. Beside them stand the base phrases, which always count.

Edge cases: null text counts as empty (no words, no labels, score 0); very long texts are scanned whole; of equal
intervals (ties) the stronger rule, then the more certain one stands; repeated rows are scanned alike; extra columns,
also with clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, pick

#: What a rule finds holds one of these or else its own keyword (see gates).
GATES = ("licen", "spdx", "copyright", "public domain", "permission", "warrant", "copyleft", "redistribut", "creativecommons", "all rights reserved")
#: label, pattern of the name, SPDX identifiers, address, literals of which the name holds one.
FAMILIES = (
    ("mit", r"(?:mit|expat|x11)", r"mit(?:-0)?", r"opensource\.org/licenses/mit", "mit|expat|x11"),
    ("apache", r"apache(?:\s+software)?", r"apache-(?:1\.0|1\.1|2\.0)", r"apache\.org/licenses", "apache"),
    ("gpl", r"(?:gnu\s+)?(?:general\s+public|gpl)", r"gpl-(?:1|2|3)\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl", "general|gpl"),
    ("lgpl", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public", r"lgpl-(?:2|2\.1|3)(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", "lesser|library"),
    ("agpl", r"(?:gnu\s+)?affero\s+general\s+public", r"agpl-(?:1|3)\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl", "affero"),
    ("gfdl", r"(?:gnu\s+)?free\s+documentation", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl", "documentation"),
    ("bsd", r"(?:(?:two|three|four|2|3|4|0)[\s-]clause\s+)?(?:new\s+|modified\s+|simplified\s+|revised\s+)?bsd(?:[\s-](?:2|3|4)[\s-]clause)?", r"(?:0bsd|bsd-[1-4]-clause(?:-[a-z]+)?)", r"opensource\.org/licenses/bsd", "bsd"),
    ("isc", r"isc", r"isc", r"opensource\.org/licenses/isc", "isc"),
    ("mpl", r"mozilla\s+public", r"mpl-(?:1\.0|1\.1|2\.0)", r"mozilla\.org/(?:en-us/)?mpl", "mozilla"),
    ("epl", r"eclipse\s+public", r"epl-(?:1|2)\.0", r"eclipse\.org/legal/epl", "eclipse"),
    ("edl", r"eclipse\s+distribution", r"edl-1\.0", r"eclipse\.org/org/documents/edl", "eclipse distribution"),
    ("cddl", r"common\s+development\s+and\s+distribution", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl", "development"),
    ("cpl", r"common\s+public", r"cpl-1\.0", r"opensource\.org/licenses/cpl", "common public|common"),
    ("cpal", r"common\s+public\s+attribution", r"cpal-1\.0", r"opensource\.org/licenses/cpal", "attribution"),
    ("eupl", r"european\s+union\s+public", r"eupl-1\.[0-2]", r"joinup\.ec\.europa\.eu/[a-z/]*eupl", "european"),
    ("artistic", r"artistic", r"artistic-(?:1|2)\.0(?:-perl|-cl8)?", r"opensource\.org/licenses/artistic", "artistic"),
    ("zlib", r"zlib(?:/libpng)?", r"zlib(?:-acknowledgement)?", r"opensource\.org/licenses/zlib", "zlib"),
    ("libpng", r"libpng", r"libpng(?:-2\.0)?", r"libpng\.org/[a-z/]*license", "libpng"),
    ("boost", r"boost\s+software", r"bsl-1\.0", r"boost\.org/license", "boost"),
    ("unlicense", r"unlicense(?:d)?", r"unlicense", r"unlicense\.org", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do\s+what\s+the\s+fuck\s+you\s+want)", r"wtfpl", r"wtfpl\.net", "wtfpl|the fuck"),
    ("cc0", r"(?:cc0|cc\s+zero|creative\s+commons\s+zero)", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero", "cc0|zero"),
    ("cc-by", r"creative\s+commons\s+attribution", r"cc-by-[1-4]\.[05]", r"creativecommons\.org/licenses/by/", "creative"),
    ("cc-by-sa", r"creative\s+commons\s+attribution[\s-]+share\s?alike", r"cc-by-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-sa/", "creative"),
    ("cc-by-nc", r"creative\s+commons\s+attribution[\s-]+non-?commercial", r"cc-by-nc-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc/", "creative"),
    ("cc-by-nd", r"creative\s+commons\s+attribution[\s-]+no\s?deriv(?:ative|s|atives)", r"cc-by-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nd/", "creative"),
    ("cc-by-nc-sa", r"creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+share\s?alike", r"cc-by-nc-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-sa/", "creative"),
    ("cc-by-nc-nd", r"creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+no\s?deriv(?:ative|s|atives)", r"cc-by-nc-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-nd/", "creative"),
    ("odbl", r"open\s+(?:data\s+commons\s+open\s+)?database", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl", "database"),
    ("odc-by", r"open\s+data\s+commons\s+attribution", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by", "data commons"),
    ("pddl", r"public\s+domain\s+dedication\s+and", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl", "dedication"),
    ("ofl", r"(?:sil\s+)?open\s+font", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl", "font"),
    ("psf", r"python\s+software\s+foundation", r"(?:psf|python)-2\.0", r"docs\.python\.org/[0-9./]*license", "python"),
    ("ruby", r"ruby", r"ruby", r"ruby-lang\.org/[a-z/]*license", "ruby"),
    ("php", r"php", r"php-3\.0[01]?", r"php\.net/license", "php"),
    ("perl", r"same\s+terms\s+as\s+perl", r"artistic-1\.0-perl", r"dev\.perl\.org/licenses", "perl"),
    ("openssl", r"openssl", r"openssl", r"openssl\.org/source/license", "openssl"),
    ("postgresql", r"postgresql", r"postgresql", r"postgresql\.org/about/licen[cs]e", "postgresql"),
    ("ms-pl", r"microsoft\s+public", r"ms-pl", r"opensource\.org/licenses/ms-pl", "microsoft"),
    ("ms-rl", r"microsoft\s+reciprocal", r"ms-rl", r"opensource\.org/licenses/ms-rl", "reciprocal"),
    ("upl", r"universal\s+permissive", r"upl-1\.0", r"oss\.oracle\.com/licenses/upl", "universal"),
    ("ncsa", r"(?:university\s+of\s+illinois/)?ncsa\s+open\s+source", r"ncsa", r"opensource\.org/licenses/ncsa", "ncsa"),
    ("osl", r"open\s+software", r"osl-[1-3]\.[01]", r"opensource\.org/licenses/osl", "open software|open"),
    ("afl", r"academic\s+free", r"afl-[1-3]\.[012]", r"opensource\.org/licenses/afl", "academic"),
    ("ecl", r"educational\s+community", r"ecl-[12]\.0", r"opensource\.org/licenses/ecl", "educational"),
    ("sspl", r"server\s+side\s+public", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license", "server"),
    ("busl", r"business\s+source", r"busl-1\.1", r"mariadb\.com/bsl", "business"),
    ("elastic", r"elastic", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license", "elastic"),
    ("lppl", r"latex\s+project\s+public", r"lppl-1\.[0-3][ac]?", r"latex-project\.org/lppl", "latex"),
    ("cecill", r"cecill(?:-[bc])?", r"cecill-(?:[1-2]\.[01]|b|c)", r"cecill\.info", "cecill"),
    ("mulan", r"mulan\s+(?:permissive|public)\s+software", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn/mulanpsl", "mulan"),
    ("vim", r"vim", r"vim", r"vimhelp\.org/[a-z.]*license", "vim"),
    ("fair", r"fair", r"fair", r"opensource\.org/licenses/fair", "fair"),
    ("w3c", r"w3c(?:\s+software)?", r"w3c(?:-19980720|-20150513)?", r"w3\.org/consortium/legal", "w3c"),
    ("intel", r"intel\s+open\s+source", r"intel", r"opensource\.org/licenses/intel", "intel"),
    ("ipl", r"ibm\s+public", r"ipl-1\.0", r"opensource\.org/licenses/ipl", "ibm"),
    ("qpl", r"q\s+public", r"qpl-1\.0", r"opensource\.org/licenses/qpl", "public"),
    ("sleepycat", r"sleepycat", r"sleepycat", r"opensource\.org/licenses/sleepycat", "sleepycat"),
    ("zpl", r"zope\s+public", r"zpl-[12]\.[01]", r"zope\.org/resources/zpl", "zope"),
    ("json", r"json", r"json", r"json\.org/license", "json"),
)

#: Priorities are 0 (strongest) to PRIORITIES - 1.
PRIORITIES = 5

#: name, label, priority, confidence, keyword, expression: sentences of license texts.
SENTENCES = (
    ("mit-grant", "mit", 1, 0.95, "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining"),
    ("mit-notice", "mit", 2, 0.8, "permission notice", r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included"),
    ("isc-grant", "isc", 1, 0.95, "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/?(?:or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("apache-grant", "apache", 1, 0.95, "licensed under the apache", r"licensed\s+under\s+the\s+apache\s+license,?\s+version\s+2\.0"),
    ("apache-comply", "apache", 2, 0.8, "compliance with the license", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license"),
    ("bsd-grant", "bsd", 1, 0.95, "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,?\s+with\s+or\s+without\s+modification"),
    ("bsd-names", "bsd", 2, 0.8, "specific prior written permission", r"neither\s+the\s+names?\s+of\s+[^.]+(?:\.(?=[\w,]|\s+(?:nor|and|or)\s)[^.]+)*\s+specific\s+prior\s+written\s+permission"),
    ("gpl-grant", "gpl", 1, 0.95, "redistribute it and/or modify", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+license"),
    ("gpl-share", "gpl", 2, 0.8, "change all versions", r"freedom\s+to\s+share\s+and\s+change\s+all\s+versions\s+of\s+a\s+program(?s:.{0,400}?)licen[cs]e"),
    ("gpl-warranty", "gpl", 3, 0.6, "implied warranty", r"without\s+even\s+the\s+implied\s+warranty\s+of\s+merchantability"),
    ("mpl-form", "mpl", 1, 0.95, "source code form is subject", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license"),
    ("unlicense-text", "unlicense", 1, 0.95, "released into the public domain", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("boost-grant", "boost", 1, 0.9, "distributed under the boost", r"distributed\s+under\s+the\s+boost\s+software\s+license,?\s+version\s+1\.0"),
    ("zlib-warranty", "zlib", 2, 0.85, "warrant", r"provided\s+'?as-is'?,?\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("public-domain", "public-domain", 3, 0.7, "public domain", r"(?:in|into|to)\s+the\s+public\s+domain"),
    ("public-domain-dedicated", "public-domain", 2, 0.85, "public domain", r"(?:dedicated?|placed|released)\s+(?:in)?to\s+the\s+public\s+domain"),
    ("all-rights", "proprietary", 3, 0.6, "all rights reserved", r"all\s+rights\s+reserved"),
    ("copyright-notice", "copyright", 4, 0.5, "copyright", r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d"),
    ("copyleft", "copyleft", 4, 0.5, "copyleft", r"copyleft"),
    ("mit-rights", "mit", 2, 0.8, "without restriction", r"deal\s+in\s+the\s+software\s+without\s+restriction,?\s+including\s+without\s+limitation"),
    ("mit-as-is", "mit", 3, 0.6, "noninfringement", r"merchantability,?\s+fitness\s+for\s+a\s+particular\s+purpose\s+and\s+noninfringement"),
    ("mit-zero", "mit", 2, 0.8, "to deal in the software without restriction", r"to\s+deal\s+in\s+the\s+software\s+without\s+restriction"),
    ("isc-notice", "isc", 2, 0.8, "appear in all copies", r"provided\s+that\s+the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+appear\s+in\s+all\s+copies"),
    ("isc-disclaims", "isc", 2, 0.75, "disclaims all warranties", r"the\s+author\s+disclaims\s+all\s+warranties\s+with\s+regard\s+to\s+this\s+software"),
    ("apache-copy", "apache", 2, 0.8, "obtain a copy of the license", r"you\s+may\s+obtain\s+a\s+copy\s+of\s+the\s+license\s+at\s+https?://www\.apache\.org"),
    ("apache-conditions", "apache", 3, 0.6, "without warranties or conditions", r"without\s+warranties\s+or\s+conditions\s+of\s+any\s+kind,?\s+either\s+express\s+or\s+implied"),
    ("apache-patent", "apache", 2, 0.8, "patent license", r"grant\s+of\s+patent\s+license\.\s+subject\s+to\s+the\s+terms\s+and\s+conditions"),
    ("bsd-source", "bsd", 2, 0.8, "redistributions of source code", r"redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice"),
    ("bsd-binary", "bsd", 2, 0.8, "redistributions in binary form", r"redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice"),
    ("bsd-advertising", "bsd", 2, 0.85, "advertising materials", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software"),
    ("bsd-disclaimer", "bsd", 3, 0.6, "provided by the copyright holders", r"this\s+software\s+is\s+provided\s+by\s+the\s+copyright\s+holders\s+and\s+contributors"),
    ("bsd-zero", "bsd", 2, 0.7, "with or without fee is hereby granted", r"for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted"),
    ("gpl-later", "gpl", 1, 0.9, "any later version", r"gnu\s+general\s+public\s+license[^.]{0,80}either\s+version\s+[123](?:\.0)?[^.]{0,60}any\s+later\s+version"),
    ("gpl-copy", "gpl", 2, 0.8, "copy of the gnu general public license", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+license"),
    ("gpl-preamble", "gpl", 2, 0.8, "take away your freedom", r"licenses\s+for\s+most\s+software[^.]{0,80}designed\s+to\s+take\s+away\s+your\s+freedom"),
    ("gpl-foundation", "gpl", 3, 0.6, "published by the free software foundation", r"as\s+published\s+by\s+the\s+free\s+software\s+foundation"),
    ("gpl-classpath", "gpl", 2, 0.8, "classpath exception|linking this library", r"classpath\s+exception|linking\s+this\s+library\s+statically\s+or\s+dynamically"),
    ("lgpl-redistribute", "lgpl", 1, 0.95, "lesser general public|library general public", r"redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public\s+license"),
    ("lgpl-combined", "lgpl", 2, 0.8, "combined work", r"convey\s+a\s+combined\s+work\s+under\s+terms\s+of\s+your\s+choice"),
    ("agpl-redistribute", "agpl", 1, 0.95, "affero general public", r"redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+license"),
    ("agpl-network", "agpl", 2, 0.85, "remote network interaction|interacting with it remotely", r"remote\s+network\s+interaction|interacting\s+with\s+it\s+remotely\s+through\s+a\s+computer\s+network"),
    ("gfdl-grant", "gfdl", 1, 0.95, "distribute and/or modify this document", r"copy,\s+distribute\s+and/or\s+modify\s+this\s+document\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+free\s+documentation"),
    ("gfdl-sections", "gfdl", 2, 0.75, "invariant sections", r"with\s+no\s+invariant\s+sections"),
    ("mpl-copy", "mpl", 2, 0.85, "copy of the mpl", r"if\s+a\s+copy\s+of\s+the\s+mpl\s+was\s+not\s+distributed\s+with\s+this\s+file"),
    ("mpl-incompatible", "mpl", 2, 0.8, "incompatible with secondary", r"incompatible\s+with\s+secondary\s+licenses"),
    ("epl-accompanying", "epl", 1, 0.9, "eclipse public", r"this\s+program\s+and\s+the\s+accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public"),
    ("epl-agreement", "epl", 2, 0.75, "recipient's acceptance", r"any\s+use,\s+reproduction\s+or\s+distribution\s+of\s+the\s+program\s+constitutes\s+recipient's\s+acceptance"),
    ("cddl-contents", "cddl", 1, 0.9, "common development and distribution", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development\s+and\s+distribution"),
    ("cddl-header", "cddl", 2, 0.75, "cddl header", r"cddl\s+header\s+(?:start|end)"),
    ("artistic-terms", "artistic", 1, 0.9, "artistic", r"under\s+the\s+terms\s+of\s+(?:either[^.]{0,80})?the\s+artistic\s+license"),
    ("artistic-package", "artistic", 2, 0.75, "standard version of", r"verbatim\s+copies\s+of\s+the\s+standard\s+version\s+of\s+this\s+package"),
    ("zlib-origin", "zlib", 2, 0.85, "must not be misrepresented", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("zlib-altered", "zlib", 2, 0.8, "altered source versions", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("boost-notices", "boost", 2, 0.8, "copyright notices in the software", r"the\s+copyright\s+notices\s+in\s+the\s+software\s+and\s+this\s+entire\s+statement"),
    ("unlicense-anyone", "unlicense", 2, 0.8, "anyone is free to copy", r"anyone\s+is\s+free\s+to\s+copy,\s+modify,\s+publish,\s+use,\s+compile,\s+sell"),
    ("wtfpl-terms", "wtfpl", 1, 0.9, "you just do", r"you\s+just\s+do\s+what\s+the\s+fuck\s+you\s+want\s+to"),
    ("cc0-waive", "cc0", 1, 0.9, "waived all copyright|waives all copyright", r"waive[sd]\s+all\s+copyright\s+and\s+related\s+or\s+neighboring\s+rights"),
    ("cc-licensed", "cc-by", 2, 0.7, "creative commons", r"this\s+work\s+is\s+licensed\s+under\s+a\s+creative\s+commons"),
    ("ofl-names", "ofl", 2, 0.8, "reserved font name", r"with\s+reserved\s+font\s+names?"),
    ("ofl-licensed", "ofl", 1, 0.95, "sil open font", r"this\s+font\s+software\s+is\s+licensed\s+under\s+the\s+sil\s+open\s+font\s+license"),
    ("psf-agreement", "psf", 1, 0.9, "python software foundation", r"this\s+license\s+agreement\s+is\s+between\s+the\s+python\s+software\s+foundation"),
    ("php-redistribution", "php", 1, 0.85, "php license", r"subject\s+to\s+version\s+[0-9.]+\s+of\s+the\s+php\s+license"),
    ("perl-same", "perl", 1, 0.9, "same terms as perl", r"redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+same\s+terms\s+as\s+perl"),
    ("openssl-toolkit", "openssl", 2, 0.85, "openssl toolkit", r"software\s+developed\s+by\s+the\s+openssl\s+project\s+for\s+use\s+in\s+the\s+openssl\s+toolkit"),
    ("postgresql-regents", "postgresql", 2, 0.7, "university of california", r"in\s+no\s+event\s+shall\s+the\s+university\s+of\s+california\s+be\s+liable"),
    ("upl-grant", "upl", 2, 0.8, "universal permissive", r"the\s+universal\s+permissive\s+license\s+\(upl\)"),
    ("eupl-work", "eupl", 1, 0.9, "under the eupl", r"licensed\s+under\s+the\s+eupl"),
    ("lppl-work", "lppl", 1, 0.9, "latex project public", r"this\s+work\s+may\s+be\s+distributed\s+and/or\s+modified\s+under\s+the\s+conditions\s+of\s+the\s+latex\s+project\s+public"),
    ("sspl-service", "sspl", 2, 0.8, "service source code", r"make\s+the\s+service\s+source\s+code\s+available"),
    ("busl-grant", "busl", 2, 0.8, "additional use grant", r"additional\s+use\s+grant\s*:"),
    ("busl-change", "busl", 2, 0.8, "change license", r"change\s+license\s*:"),
    ("elastic-service", "elastic", 2, 0.8, "hosted or managed service", r"may\s+not\s+provide\s+the\s+software\s+to\s+third\s+parties\s+as\s+a\s+hosted\s+or\s+managed\s+service"),
    ("proprietary-confidential", "proprietary", 2, 0.75, "confidential", r"proprietary\s+and\s+confidential"),
    ("proprietary-copying", "proprietary", 2, 0.75, "unauthorized copying", r"unauthorized\s+copying\s+of\s+this\s+file,?\s+via\s+any\s+medium"),
    ("proprietary-eula", "proprietary", 3, 0.65, "end user|end-user", r"end[\s-]user\s+licen[cs]e\s+agreement"),
    ("commercial-only", "non-commercial", 3, 0.6, "commercial", r"(?:for\s+)?non-?commercial\s+(?:use|purposes)\s+only"),
    ("json-evil", "json", 1, 0.9, "for good, not evil", r"the\s+software\s+shall\s+be\s+used\s+for\s+good,\s+not\s+evil"),
    ("beerware", "beerware", 2, 0.8, "beer", r"buy\s+me\s+a\s+beer"),
)


def _keyword(url: str) -> str:
    """A literal part of an address pattern: its host, or licen if the address holds that."""
    return "licen" if "licen" in url else "creativecommons" if "creativecommons" in url else url.split("/")[0].replace("\\", "")


def rules() -> list[tuple[str, str, int, float, str, str]]:
    """All rules in order. An SPDX line beats a grant sentence, which beats an address, which beats a bare name."""
    out = list(SENTENCES)
    for label, name, spdx, url, literals in FAMILIES:
        out.append((f"{label}-spdx", label, 0, 1.0, "spdx-license-identifier", rf"spdx-license-identifier:\s*{spdx}(?![\w.+-])"))
        out.append((f"{label}-under", label, 1, 0.9, literals, rf"(?:licen[cs]ed|released|distributed|available|provided)\s+under\s+(?:the\s+terms\s+of\s+)?(?:the\s+|an?\s+)?{name}(?:\s+(?:public\s+)?licen[cs]e)(?![\w])"))
        out.append((f"{label}-url", label, 2, 0.85, _keyword(url), url))
        out.append((f"{label}-name", label, 3, 0.7, literals, rf"(?<![\w-]){name}\s+licen[cs]es?(?![\w])"))
    return out


def gates() -> list[str]:
    """Words of which a document must hold one to be looked at: each match of a rule holds one of them."""
    out = set(GATES)
    for *_, keywords, pattern in rules():
        if "licen" not in pattern:
            out |= {k for k in keywords.split("|") if not any(g in k for g in GATES)}
    return sorted(out)


#: Base phrases: words and label.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row. No shuffle."""
    table = rules()
    lit = F.array(*[F.struct(F.lit(r[1]).alias("label"), F.lit(r[2]).alias("prio"), F.lit(r[3]).alias("conf"), F.array(*[F.lit(k) for k in r[4].split("|")]).alias("kw"), F.lit(r[5]).alias("re")) for r in table])
    step = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    step = step.withColumn("__near", F.regexp_replace(F.lower("text"), r"\s+", " "))  # its own column: made once for all gates
    gated = F.lit(False)
    for g in gates():
        gated = gated | F.contains("__near", F.lit(g))
    step = step.withColumn("__gated", gated).drop("__near")
    step = step.withColumn("__t", F.when(F.col("__gated"), F.translate("text", UPPER, LOWER)))
    step = step.withColumn("__s", F.regexp_replace("__t", r"\s+", " "))
    step = step.withColumn("n_words", F.size(F.array_remove(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), "")).cast("long"))
    step = step.withColumn("__w", F.when(F.contains("__t", F.lit("license")), F.array_remove(F.split("__t", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")))
    cases = " ".join(f"WHEN i >= {len(words) - 1} AND " + " AND ".join(f"__w[i - {len(words) - 1 - k}] = '{w}'" for k, w in enumerate(words)) + f" THEN named_struct('p', i - {len(words) - 1}, 'l', '{label}')" for words, label in PHRASES)
    ends = ", ".join(sorted({f"'{words[-1]}'" for words, _ in PHRASES}))
    step = step.withColumn("__b", F.expr(f"CASE WHEN __w IS NOT NULL THEN filter(transform(__w, (x, i) -> CASE WHEN x NOT IN ({ends}) THEN NULL {cases} END), x -> x IS NOT NULL) END"))
    step = step.withColumn("__r", F.when(F.col("__gated"), F.filter(lit, lambda r: F.exists(r["kw"], lambda k: F.contains(F.col("__s"), k)))))
    step = step.withColumn("__m", F.expr("filter(transform(__r, r -> named_struct('r', r, 'm', regexp_extract_all(__t, r.re, 0))), x -> size(x.m) > 0)"))
    # place of the k-th match of a rule: what was split off before it plus the matches before it
    step = step.withColumn("__h", F.expr(
        "flatten(transform(__m, x -> aggregate(zip_with(x.m, slice(split(__t, x.r.re, -1), 1, size(x.m)), (m, g) -> named_struct('m', length(m), 'g', length(g))),"
        " named_struct('at', 0, 'hits', cast(array() AS array<struct<s: int, e: int, p: int, c: double, l: string>>)),"
        " (a, y) -> named_struct('at', a.at + y.g + y.m, 'hits', concat(a.hits, array(named_struct('s', a.at + y.g, 'e', -(a.at + y.g + y.m), 'p', x.r.prio, 'c', cast(x.r.conf AS double), 'l', x.r.label))))).hits))"))
    step = step.withColumn("__h", F.expr("sort_array(__h)"))  # by start, longest first, strongest first
    # kept intervals begin no later than the next, so one contains it if it ends no earlier: the last end of each priority says it
    step = step.withColumn("__k", F.expr(
        f"aggregate(__h, named_struct('ends', array_repeat(-1, {PRIORITIES}), 'labels', cast(array() AS array<string>), 'score', 0.0D),"
        " (a, h) -> IF(array_max(slice(a.ends, 1, h.p + 1)) >= -h.e, a, named_struct('ends', transform(a.ends, (x, i) -> IF(i = h.p, greatest(x, -h.e), x)),"
        " 'labels', array_union(a.labels, array(h.l)), 'score', greatest(a.score, h.c))))"))
    base = F.expr("array_sort(array_distinct(transform(__b, x -> x.l)))")
    base = F.coalesce(base, F.expr("cast(array() AS array<string>)"))
    n_base = F.coalesce(F.size("__b"), F.lit(0))
    n_base = F.when(F.col("__b").isNull(), F.lit(0)).otherwise(n_base)
    labels = F.array_sort(F.array_union(base, F.coalesce("__k.labels", F.expr("cast(array() AS array<string>)"))))
    score = F.greatest(F.coalesce("__k.score", F.lit(0.0)), F.when(n_base > 0, F.lit(0.7)).otherwise(F.lit(0.0)))
    return step.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(F.expr("transform(__b, x -> x.p)")).cast("long").alias("first_word"),
        F.array_max(F.expr("transform(__b, x -> x.p)")).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
