"""Signatures of license texts, written by hand: passages that tell one text from
the others, over normalised words. Each is ``(label, keyword, pattern, weight)``;
the keyword is a word that every match holds."""

TEXTS = (
    # permission notices of the MIT and related kinds
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", 0.97),
    ("mit", "merchantability", r"warranties of merchantability fitness for a particular purpose and non ?infringement", 0.7),
    ("mit", "substantial", r"copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 0.95),
    ("mit", "tort", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software", 0.9),
    ("mit-0", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software (?:\w+ ){0,40}?to permit persons to whom the software is furnished to do so the software is provided", 0.9),
    ("mit", "licen", r"(?:the )?(?:mit|expat|x11) licen[cs]e", 0.95),
    ("mit", "licensed", r"licensed under (?:the )?mit", 0.93),
    ("mit", "mit", r"license mit|mit licensed", 0.85),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 0.97),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.97),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties", 0.85),
    ("isc", "licen", r"(?:the )?isc licen[cs]e", 0.95),
    ("0bsd", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", 0.95),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[cs]e)?", 0.95),
    ("hpnd", "advertising", r"that the name of \w+(?: \w+){0,4} not be used in advertising or publicity pertaining to distribution of the software", 0.9),
    ("ntp", "suitability", r"makes no representations about the suitability (?:of )?this software for any purpose", 0.85),
    ("curl", "curl", r"(?:the )?curl licen[cs]e", 0.9),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source license", 0.97),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[cs]e", 0.95),
    ("postgresql", "university", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", 0.8),
    ("icu", "unicode", r"unicode (?:terms of use|license agreement data files and software)", 0.9),
    ("unicode-dfs", "unicode", r"unicode data files and any associated documentation", 0.93),
    ("bsl-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.97),
    ("bsl-1.0", "machine", r"solely in the form of machine executable object code generated by a source language processor", 0.95),
    ("json", "evil", r"the software shall be used for good not evil", 0.97),
    ("mit-feh", "acknowledgement", r"and acknowledgement shall be given in the documentation (?:and )?software packages", 0.9),
    ("fsful", "unlimited", r"the free software foundation gives unlimited permission to copy and or distribute it with or without modifications", 0.95),
    ("smlnj", "jersey", r"standard ml of new jersey copyright notice license and disclaimer", 0.95),
    ("naist", "nara", r"nara institute of science and technology(?: \w+){0,6} permission", 0.85),
    # the BSD kinds
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", 0.95),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", 0.95),
    ("bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms(?: with or without modification)?", 0.9),
    ("bsd-2-clause", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd-2-clause", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.88),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?", 0.95),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?", 0.95),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?", 0.95),
    ("bsd-2-clause-views", "freebsd", r"official policies either expressed or implied of the freebsd project|the freebsd (?:copyright|licen[cs]e)", 0.9),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause plus patent(?: licen[cs]e)?", 0.95),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license", 0.95),
    ("bsd-3-clause-nuclear", "nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", 0.93),
    ("bsd-source-code", "redistributions", r"redistributions of source code must retain the original copyright notice", 0.8),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e", 0.85),
    ("bsd", "bsd", r"licensed under (?:the )?bsd", 0.85),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.0", "apache", r"this product includes software developed by the apache group", 0.93),
    # the Apache text
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "perpetual", r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", 0.95),
    ("apache-2.0", "trademarks", r"this license does not grant permission to use the trade names trademarks service marks or product names of the licensor", 0.95),
    ("apache-2.0", "contributor", r"each contributor provides its contributions on an as is basis without warranties or conditions of any kind", 0.93),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0", 0.97),
    ("apache-1.1", "apache", r"www apache org licenses license 1 1", 0.97),
    ("apache-2.0", "distributed", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.93),
    ("apache", "apache", r"licensed under (?:the )?apache", 0.9),
    ("apache", "apache", r"apache software foundation(?: asf)? under one or more contributor license agreements", 0.95),
    ("ecl-2.0", "educational", r"educational community license version 2 0 (?:the license|ecl)", 0.97),
    # the GNU texts
    ("gpl", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.97),
    ("lgpl", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.97),
    ("agpl", "affero", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.97),
    ("gpl", "freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", 0.95),
    ("gpl-3.0", "propagate", r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable", 0.95),
    ("gpl-3.0", "consumer", r"a user product is either 1 a consumer product", 0.9),
    ("gpl-3.0", "technological", r"no covered work shall be deemed part of an effective technological measure", 0.95),
    ("gpl-2.0", "verbatim", r"you may copy and distribute verbatim copies of the program s source code as you receive it", 0.93),
    ("gpl-2.0", "machine", r"accompany it with the complete corresponding machine readable source code which must be distributed", 0.88),
    ("gpl", "warranty", r"this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with this program", 0.95),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)", 0.95),
    ("agpl", "gnu", r"you should have received a copy of the gnu affero general public license along with this program", 0.95),
    ("gpl", "gnu", r"www gnu org licenses(?: gpl(?: \d \d)?(?: html| txt)?)?", 0.75),
    ("agpl-3.0", "interacting", r"all users interacting with it remotely through a computer network", 0.95),
    ("lgpl-2.1", "library", r"a work that uses the library", 0.75),
    ("lgpl-3.0", "combined", r"a combined work is a work produced by combining or linking an application with the library", 0.95),
    ("gpl-classpath", "exception", r"(?:with )?(?:the )?classpath exception", 0.93),
    ("gpl-classpath", "linking", r"linking this library statically or dynamically with other modules is making a combined work", 0.93),
    ("gpl-gcc", "exception", r"gcc runtime library exception", 0.95),
    ("gpl-font", "font", r"if you create a document which uses this font and embed this font", 0.93),
    ("gpl-bison", "bison", r"you may create a larger work that contains part or all of the bison parser skeleton", 0.95),
    ("gpl-autoconf", "exception", r"autoconf (?:configure script )?exception", 0.85),
    ("gpl-openssl", "openssl", r"permission to link the code of (?:\w+ ){0,12}?with the openssl (?:project s openssl )?library", 0.93),
    ("gpl-linking", "link", r"linking exception|as a special exception the copyright holders (?:of this library )?give you permission to link", 0.85),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.97),
    # Mozilla, Eclipse and other file-based texts
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.98),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 0.98),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses", 0.95),
    ("npl", "netscape", r"netscape public licen[cs]e(?: version 1 [01])?", 0.95),
    ("epl", "eclipse", r"(?:this program and the )?accompanying materials are made available under the terms of the eclipse public license", 0.97),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: v ?1 0)?", 0.95),
    ("cddl", "distribution", r"subject to the terms of the common development and distribution license", 0.95),
    ("cpl-1.0", "common", r"accompanying materials are made available under the terms of the common public license", 0.95),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: version 1 0)?", 0.95),
    ("spl", "sun", r"sun public licen[cs]e(?: version 1 0)?", 0.93),
    ("qpl", "public", r"(?:the )?q public licen[cs]e(?: version 1 0)?", 0.95),
    ("rpl", "reciprocal", r"reciprocal public licen[cs]e(?: 1 [15])?", 0.95),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e(?: ms pl)?", 0.97),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e(?: ms rl)?", 0.97),
    ("ms-lpl", "microsoft", r"microsoft limited public licen[cs]e", 0.95),
    ("ms-pl", "patent", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software", 0.9),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: version 1 3)?", 0.95),
    ("apsl", "apple", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", 0.97),
    ("watcom-1.0", "sybase", r"sybase open watcom public licen[cs]e", 0.95),
    ("intel", "intel", r"intel open source licen[cs]e", 0.9),
    ("lucent-1.02", "lucent", r"lucent public licen[cs]e(?: version 1 02)?", 0.95),
    ("nokia", "nokia", r"nokia open source licen[cs]e", 0.93),
    ("realnetworks", "realnetworks", r"realnetworks public source licen[cs]e", 0.93),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat licen[cs]e", 0.93),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 0.93),
    ("oclc-2.0", "oclc", r"oclc research public licen[cs]e", 0.95),
    ("cnri", "cnri", r"cnri (?:open source )?licen[cs]e agreement", 0.93),
    ("python-2.0", "licen", r"(?:python software foundation|psf) licen[cs]e(?: agreement)?(?: for python)?(?: version 2)?", 0.95),
    ("python-2.0", "python", r"psf is making python available to licensee on an as is basis", 0.95),
    ("ruby", "ruby", r"(?:the )?ruby(?: s)? licen[cs]e", 0.9),
    ("perl", "perl", r"(?:under )?the same terms as perl(?: itself)?", 0.93),
    ("artistic-1.0", "package", r"the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic-2.0", "package", r"this license establishes the terms under which a given free software package may be copied modified distributed", 0.95),
    ("php", "php", r"this product includes php(?: software)?(?: freely available)?", 0.9),
    ("vim", "vim", r"(?:the )?vim licen[cs]e", 0.9),
    ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e(?: terms)?", 0.9),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 0.95),
    ("openssl", "openssl", r"openssl licen[cs]e", 0.9),
    ("ssleay", "young", r"this product includes cryptographic software written by eric young", 0.95),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.93),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 0.95),
    ("libpng", "png", r"png reference library licen[cs]e|libpng licen[cs]e", 0.93),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 0.95),
    ("libtiff", "leffler", r"the names of sam leffler and silicon graphics may not be used in any advertising", 0.95),
    ("freetype", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e|portions of this software are copyright (?:\w+ ){0,4}?the freetype project", 0.93),
    ("ofl-1.1", "font", r"the fonts and derivatives however cannot be released under any other type of license", 0.95),
    ("ofl-1.1", "reserved", r"no modified version of the font software may use the reserved font name", 0.95),
    ("bitstream-vera", "bitstream", r"bitstream vera (?:fonts )?copyright", 0.9),
    ("ubuntu-font", "ubuntu", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", 0.95),
    ("lppl", "latex", r"this work may be distributed and or modified under the conditions of the latex project public license", 0.97),
    ("w3c", "w3c", r"w3c software (?:notice and )?(?:license|document license)", 0.95),
    ("ogc", "geospatial", r"open geospatial consortium(?: \w+){0,3} licen[cs]e", 0.9),
    ("osl-3.0", "open", r"licensed under the open software license version 3 0", 0.97),
    ("afl-3.0", "academic", r"licensed under the academic free license version 3 0", 0.97),
    ("eupl", "eupl", r"licensed under the eupl", 0.93),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? license under french law", 0.97),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software|psl)(?: licen[cs]e)?(?: version 2| v2)?", 0.95),
    ("odbl-1.0", "database", r"open database licen[cs]e(?: odbl)?(?: v ?1 0)?", 0.95),
    ("odc-by-1.0", "commons", r"open data commons attribution licen[cs]e", 0.95),
    ("pddl-1.0", "dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", 0.93),
    ("cdla-permissive", "data", r"community data licen[cs]e agreement permissive", 0.95),
    ("cdla-sharing", "data", r"community data licen[cs]e agreement sharing", 0.95),
    ("ogl-uk-3.0", "government", r"open government licen[cs]e(?: v ?3 0)?", 0.93),
    ("etalab-2.0", "ouverte", r"licence ouverte(?: open licence)?(?: 2 0)?", 0.93),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: version 1)?", 0.97),
    ("busl-1.1", "business", r"business source licen[cs]e(?: 1 1)?", 0.97),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: 2 0)?", 0.95),
    ("commons-clause", "commons", r"commons clause(?: licen[cs]e condition)?", 0.93),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) licen[cs]e", 0.97),
    ("parity", "parity", r"parity public licen[cs]e", 0.95),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?: [ms])? licen[cs]e", 0.95),
    ("openrail", "responsible", r"responsible ai licen[cs]e", 0.95),
    ("blueoak-1.0.0", "oak", r"blue oak model licen[cs]e", 0.97),
    ("anti-996", "996", r"anti 996 licen[cs]e", 0.95),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e", 0.95),
    # dedications and jokes
    ("unlicense", "unlicense", r"(?:the )?unlicense", 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.97),
    ("cc0-1.0", "cc0", r"cc0 1 0 universal(?: public domain dedication)?", 0.9),
    ("cc0-1.0", "waived", r"(?:has|have) waived all copyright and related or neighboring rights", 0.95),
    ("wtfpl", "wtfpl", r"wtfpl", 0.9),
    ("wtfpl", "fuck", r"do what the fuck you want to(?: public licen[cs]e)?", 0.97),
    ("beerware", "beer", r"you can buy me a beer in return|beer ?ware licen[cs]e", 0.95),
    ("public-domain", "domain", r"(?:released (?:in)?to|placed in|dedicated to) the public domain", 0.85),
    ("public-domain", "disclaims", r"the author disclaims copyright to this source code", 0.9),
    ("public-domain", "blessing", r"in place of a legal notice here is a blessing", 0.95),
    # reserved rights
    ("proprietary", "reserved", r"all rights reserved", 0.6),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.9),
    ("proprietary", "prohibited", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", 0.95),
    ("proprietary", "unpublished", r"this is unpublished proprietary source code", 0.95),
    ("proprietary", "evaluation", r"(?:for )?evaluation (?:purposes only|licen[cs]e agreement)", 0.8),
    ("proprietary", "agreement", r"end user licen[cs]e agreement(?: eula)?", 0.85),
    ("proprietary", "disclosure", r"subject to (?:a )?non ?disclosure agreement", 0.8),
    ("non-commercial", "commercial", r"for non ?commercial (?:use|purposes) only|not for commercial use", 0.85),
    ("academic-only", "only", r"for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) only", 0.85),
)
