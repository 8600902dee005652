"""Signature sentences of license texts and notices, written by hand.

Each line is a regular expression over lower-case words that single blanks separate
(punctuation is gone), the label that it gives and its priority. A sentence that one license
alone has is at 90 or more, one that a family shares at 60 to 85, a loose mention below.
"""

#: Expression, label, priority.
SIGNATURES = (
    # mit and its relatives
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 97),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 92),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "mit", 94),
    ("the above copyright notice and this permission notice (?:\\w+ ){0,6}?shall be included in all copies or substantial portions of the software", "mit", 90),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability", "mit", 70),
    ("without written agreement and without license or royalty fees to use copy modify and distribute this software", "mit-modern-variant", 88),
    ("the above copyright notice and this permission notice may be omitted|permission is hereby granted without written agreement", "mit-no-attribution", 80),
    # isc, 0bsd, historical permission notices
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "isc", 97),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", "0bsd", 95),
    ("permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "hpnd", 92),
    ("the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc", 75),
    ("in no event shall the author be liable for any special direct indirect or consequential damages", "isc", 65),
    # bsd
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", 88),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", 84),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd", 84),
    ("neither the names? of (?:\\w+ ){1,12}?(?:nor|or) the names of (?:its|their|any|other) contributors may be used to endorse or promote products", "bsd-3-clause", 94),
    ("all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause", 95),
    ("this software is provided by (?:\\w+ ){1,12}?as is and any express(?:ed)? or implied warranties including but not limited to the implied warranties of merchantability", "bsd", 66),
    ("the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies", "bsd-2-clause-views", 90),
    ("no express or implied licenses to any party s patent rights are granted by this license", "bsd-3-clause-clear", 93),
    ("you acknowledge that this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "bsd-3-clause-no-nuclear", 92),
    # apache
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2", 98),
    ("you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0", "apache-2", 95),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2", 86),
    ("apache license version 2 0 january 2004", "apache-2", 97),
    ("terms and conditions for use reproduction and distribution", "apache-2", 60),
    ("each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache-2", 90),
    ("see the notice file distributed with this work for additional information regarding copyright ownership", "apache-2", 88),
    ("products derived from this software may not be called apache nor may apache appear in their name", "apache-1.1", 95),
    ("this product includes software developed by the apache (?:group|software foundation)", "apache-1.1", 82),
    # gpl
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 88),
    ("either version 1 or at your option any later version", "gpl-1", 80),
    ("under the terms of the gnu general public license as published by the free software foundation either version 2", "gpl-2", 94),
    ("under the terms of the gnu general public license as published by the free software foundation either version 3", "gpl-3", 94),
    ("under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation", "gpl-2", 94),
    ("under the terms of the gnu general public license version 3 (?:only )?as published by the free software foundation", "gpl-3", 94),
    ("gnu general public license version 2 june 1991", "gpl-2", 97),
    ("gnu general public license version 3 29 june 2007", "gpl-3", 97),
    ("gnu general public license version 1 february 1989", "gpl-1", 97),
    ("you should have received a copy of the gnu general public license along with this program", "gpl", 84),
    ("the licenses for most software are designed to take away your freedom to share and change it", "gpl-2", 90),
    ("the gnu general public license is a free copyleft license for software and other kinds of works", "gpl-3", 95),
    ("activities other than copying distribution and modification are not covered by this license they are outside its scope", "gpl-2", 90),
    ("you must cause the modified files to carry prominent notices stating that you changed the files", "gpl-2", 85),
    ("conveying verbatim copies|conveying modified source versions|conveying non source forms", "gpl-3", 82),
    ("basic permissions all rights granted under this license are granted for the term of copyright on the program", "gpl-3", 92),
    ("as a special exception (?:\\w+ ){0,12}?(?:gives?|grants?) (?:\\w+ ){0,3}?permission to link", "gpl-linking-exception", 86),
    ("classpath exception|linking this library statically or dynamically with other modules is making a combined work based on this library", "gpl-classpath-exception", 88),
    ("gcc runtime library exception", "gpl-gcc-exception", 88),
    # lgpl
    ("under the terms of the gnu library general public license", "lgpl-2", 90),
    ("under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", "lgpl-2.1", 96),
    ("under the terms of the gnu lesser general public license as published by the free software foundation either version 3", "lgpl-3", 96),
    ("this library is free software you can redistribute it and or modify it", "lgpl", 86),
    ("you should have received a copy of the gnu (?:lesser|library) general public license along with this", "lgpl", 85),
    ("gnu lesser general public license version 2 1 february 1999", "lgpl-2.1", 97),
    ("gnu lesser general public license version 3 29 june 2007", "lgpl-3", 97),
    ("a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it", "lgpl-2.1", 90),
    ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", "lgpl-3", 95),
    # agpl, gfdl, sspl
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl-3", 96),
    ("gnu affero general public license version 3 19 november 2007", "agpl-3", 98),
    ("remote network interaction use with the gnu general public license", "agpl-3", 94),
    ("you should have received a copy of the gnu affero general public license along with this program", "agpl-3", 93),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 97),
    ("with no invariant sections no front cover texts and no back cover texts", "gfdl", 94),
    ("a copy of the license is included in the section entitled gnu free documentation license", "gfdl", 93),
    ("offering the program as a service|if you make the functionality of the program or a modified version available to third parties as a service", "sspl-1", 93),
    ("server side public license version 1 october 16 2018", "sspl-1", 97),
    # mozilla, netscape, sun, ibm, eclipse
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", 98),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2", 96),
    ("this source code form is incompatible with secondary licenses", "mpl-2-no-copyleft-exception", 94),
    ("the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 97),
    ("the contents of this file are subject to the mozilla public license version 1 0", "mpl-1.0", 97),
    ("software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language", "mpl-1.1", 86),
    ("the initial developer of the original code is", "mpl-1.1", 78),
    ("alternatively the contents of this file may be used under the terms of either the gnu general public license", "mpl-1.1", 82),
    ("the contents of this file are subject to the netscape public license version 1 [01]", "npl", 96),
    ("the contents of this file are subject to the terms of the common development and distribution license", "cddl-1", 97),
    ("common development and distribution license (?:cddl )?version 1 0", "cddl-1", 94),
    ("you can obtain a copy of the license at (?:\\w+ ){0,6}?cddl", "cddl-1", 85),
    ("the contents of this file are subject to the sun public license version 1 0", "spl-1", 96),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", "epl-1", 98),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0", "epl-2", 98),
    ("the accompanying program is provided under the terms of this eclipse public license agreement", "epl", 93),
    ("this source code may also be made available under the following secondary licenses", "epl-2", 92),
    ("this program and the accompanying materials are made available under the terms of the common public license v1 0", "cpl-1", 98),
    ("the accompanying program is provided under the terms of this common public license agreement", "cpl-1", 95),
    ("ibm public license version 1 0", "ipl-1", 92),
    ("made available under the terms of the eclipse distribution license v1 0", "bsd-3-clause", 93),
    # european, academic, open group
    ("licensed under the eupl version 1 2", "eupl-1.2", 97),
    ("licensed under the eupl version 1 1", "eupl-1.1", 97),
    ("you may not use this work except in compliance with the licence", "eupl", 88),
    ("this european union public licence the eupl applies to the work", "eupl", 93),
    ("licensed under the academic free license version [123] [01]", "afl", 95),
    ("licensed under the open software license version [123] [01]", "osl", 95),
    ("educational community license version 2 0", "ecl-2", 93),
    ("governed by the cecill(?: [bc])? licen[cs]e under french law and abiding by the rules of distribution of free software", "cecill", 97),
    ("as a counterpart to the access to the source code and rights to copy modify and redistribute granted by the license", "cecill", 92),
    ("mulan p(?:ermissive software license|sl)(?: v| version)? ?2", "mulanpsl-2", 92),
    ("developed at the university of illinois|university of illinois ncsa open source license", "ncsa", 88),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "ncsa", 86),
    # artistic, perl, python, ruby, php
    ("the intent of this document is to state the conditions under which a package may be copied", "artistic-1", 95),
    ("this package is free software you can redistribute it and or modify it under the same terms as perl itself", "artistic-perl", 93),
    ("the artistic license 2 0 copyright", "artistic-2", 94),
    ("this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "artistic-2", 95),
    ("you are always permitted to make arrangements wholly outside of this license directly with the copyright holder of a given package", "artistic-2", 93),
    ("this license agreement is between the python software foundation psf and the individual or organization", "python-2", 97),
    ("psf hereby grants licensee a nonexclusive royalty free world wide license", "python-2", 95),
    ("beopen com license agreement for python|beopen python open source license agreement", "python-2", 92),
    ("cnri open source license agreement|cnri license agreement for python", "python-2", 90),
    ("you may make and give away verbatim copies of the source form of the software without restriction", "ruby", 85),
    ("ruby is copyrighted free software by yukihiro matsumoto", "ruby", 97),
    ("this source file is subject to version 3 0?1? ?of the php license", "php-3", 96),
    ("the name php must not be used to endorse or promote products derived from this software", "php-3", 93),
    ("this product includes php software freely available from", "php-3", 90),
    # boost, zlib, unlicense, wtfpl, curl, openssl and other small ones
    ("boost software license version 1 0 august 17th 2003", "boost-1", 98),
    ("distributed under the boost software license version 1 0", "boost-1", 96),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost-1", 97),
    ("the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer", "boost-1", 93),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", 95),
    ("the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", 96),
    ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib", 94),
    ("this is free and unencumbered software released into the public domain", "unlicense", 98),
    ("anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 95),
    ("in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "unlicense", 95),
    ("do what the fuck you want to public license", "wtfpl", 97),
    ("you just do what the fuck you want to", "wtfpl", 96),
    ("as long as you retain this notice you can do whatever you want with this stuff if we meet some day", "beerware", 97),
    ("you can buy me a beer in return", "beerware", 93),
    ("this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 97),
    ("the names openssl toolkit and openssl project must not be used to endorse or promote products", "openssl", 95),
    ("this product includes cryptographic software written by eric young", "ssleay", 95),
    ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "curl", 95),
    ("the fsf makes no warranty|copying and distribution of this file with or without modification are permitted in any medium without royalty", "fsf-all-permissive", 90),
    ("permission is granted to make and distribute verbatim copies of this manual provided the copyright notice", "latex2e", 90),
    ("this work may be distributed and or modified under the conditions of the latex project public license", "lppl", 97),
    ("the latex project public license lppl is the primary license", "lppl", 95),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", 96),
    ("in no event shall (?:the university of california|\\w+ \\w+) be liable to any party for direct indirect special incidental or consequential damages", "postgresql", 82),
    ("by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", "w3c", 96),
    ("w3c software notice and license", "w3c", 94),
    ("distribution of this software is permitted under the icu license|permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode", 95),
    ("the universal permissive license upl version 1 0", "upl-1", 97),
    ("subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "upl-1", 95),
    ("this license governs use of the accompanying software if you use the software you accept this license", "ms-pl", 90),
    ("if you distribute any portion of the software in source code form you may do so only under this license", "ms-pl", 90),
    ("for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code", "ms-rl", 94),
    ("permission is granted to anyone to use this software for any purpose including commercial applications", "zlib", 92),
    ("blue oak model license", "blueoak-1", 90),
    ("each contributor licenses you to do everything with this software that would otherwise infringe", "blueoak-1", 95),
    # fonts and documents
    ("this font software is licensed under the sil open font license version 1 1", "ofl-1.1", 98),
    ("the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "ofl-1.1", 96),
    ("neither the font software nor any of its individual components in original or modified versions may be sold by itself", "ofl-1.1", 95),
    ("ubuntu font licence version 1 0", "ufl-1", 95),
    ("the bitstream vera fonts? copyright|bitstream vera is a trademark of bitstream", "bitstream-vera", 92),
    ("gust font license", "gfl", 88),
    ("redistribution and use in source docbook form and compiled forms", "freebsd-doc", 92),
    # creative commons
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", "cc0-1", 97),
    ("to the extent possible under law (?:\\w+ ){1,12}?has waived all copyright and related or neighboring rights", "cc0-1", 97),
    ("cc0 1 0 universal", "cc0-1", 96),
    ("this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic)? ?license", "cc-by", 93),
    ("this work is licensed under a creative commons attribution share ?alike (?:[1-4] [05] )?(?:international|unported|generic)? ?license", "cc-by-sa", 95),
    ("this work is licensed under a creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international|unported|generic)? ?license", "cc-by-nc", 95),
    ("this work is licensed under a creative commons attribution non ?commercial share ?alike (?:[1-4] [05] )?(?:international|unported|generic)? ?license", "cc-by-nc-sa", 97),
    ("this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] [05] )?(?:international|unported|generic)? ?license", "cc-by-nc-nd", 97),
    ("this work is licensed under a creative commons attribution no ?deriv(?:ative)?s (?:[1-4] [05] )?(?:international|unported|generic)? ?license", "cc-by-nd", 95),
    ("text is available under the creative commons attribution share ?alike license additional terms may apply", "cc-by-sa", 95),
    ("you are free to share copy and redistribute the material in any medium or format", "creative-commons", 82),
    ("under the following terms attribution you must give appropriate credit provide a link to the license and indicate if changes were made", "creative-commons", 84),
    ("if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "cc-by-sa", 88),
    ("you may not use the material for commercial purposes", "cc-by-nc", 85),
    ("if you remix transform or build upon the material you may not distribute the modified material", "cc-by-nd", 88),
    ("creative commons corporation is not a law firm and does not provide legal services", "creative-commons", 86),
    # data
    ("this (?:database|dataset|data) is made available under the open database license", "odbl-1", 97),
    ("any rights in individual contents of the database are licensed under the database contents license", "odbl-1", 96),
    ("contains information from (?:\\w+ ){1,8}?which is made available under the odc attribution license", "odc-by-1", 96),
    ("this (?:database|dataset|data) is made available under the public domain dedication and license", "pddl-1", 97),
    ("community data license agreement permissive version [12] 0", "cdla-permissive", 95),
    ("community data license agreement sharing version 1 0", "cdla-sharing", 95),
    ("contains public sector information licensed under the open government licence v[123] 0", "ogl", 96),
    ("openstreetmap contributors (?:\\w+ ){0,6}?open data commons open database license|data is available under the open database license", "odbl-1", 92),
    # source-available and model licenses
    ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "bsl-1.1", 97),
    ("effective on the change date or the fourth anniversary of the first publicly available distribution", "bsl-1.1", 96),
    ("you may not provide the software to third parties as a hosted or managed service", "elastic-2", 96),
    ("commons clause license condition v1 0", "commons-clause", 97),
    ("the license does not grant to you the right to sell the software", "commons-clause", 94),
    ("polyform (?:noncommercial|small business|shield|strict|perimeter) license 1 0 0", "polyform", 96),
    ("prosperity public license", "prosperity", 88),
    ("use restrictions as referenced in paragraph 5|creativeml open rail(?: m)?", "openrail", 90),
    ("community license agreement (?:\\w+ ){0,6}?700 million monthly active users|greater than 700 million monthly active users", "community-model", 92),
    # proprietary and general
    ("this software is (?:the )?confidential and proprietary information of", "proprietary", 90),
    ("unauthorized copying of this file via any medium is strictly prohibited", "proprietary", 92),
    ("no part of this (?:publication|book|document|work) may be reproduced(?: stored)?", "all-rights-reserved", 80),
    ("this program is protected by copyright law and international treaties", "proprietary", 84),
    ("end user license agreement", "proprietary", 55),
    ("for evaluation purposes only", "proprietary", 50),
    ("restricted rights use duplication or disclosure by the (?:u s )?government is subject to restrictions", "proprietary", 82),
    ("for personal use only|for academic use only|for research purposes only|for non ?commercial use only", "non-commercial", 50),
)
