"""Licence notices to look for. The wording of the licences themselves."""

from __future__ import annotations

#: Phrases whose every place counts, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_DISCLAIMER = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including
but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright
holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised
of the possibility of such damage"""

_REDISTRIBUTION = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution"""

_ENDORSE = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission"""


def _foundation(name: str, version: str) -> str:
    return f"""this program is free software you can redistribute it and or modify it under the terms of the {name} as published by the free
software foundation either version {version} of the license or at your option any later version this program is distributed in the hope that it will be
useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for
more details you should have received a copy of the {name} along with this program"""


#: Label, text, and the phrases without which a text is not that licence.
NOTICES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is
without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract
tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
     ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with
regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct
indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or
other tortious action arising out of or in connection with the use or performance of this software""",
     ("with or without fee is hereby granted",)),
    ("bsd-2-clause", f"{_REDISTRIBUTION} {_DISCLAIMER}", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", f"{_REDISTRIBUTION} {_ENDORSE} {_DISCLAIMER}", ("redistribution and use in source and binary forms", "endorse or promote products")),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed
under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the
specific language governing permissions and limitations under the license""",
     ("apache license version 2 0", "in compliance with the license")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", _foundation("gnu general public license", "3"), ("gnu general public license", "either version 3")),
    ("gpl-2.0", _foundation("gnu general public license", "2"), ("gnu general public license", "either version 2")),
    ("lgpl-2.1", _foundation("gnu lesser general public license", "2 1"), ("gnu lesser general public license", "either version 2 1")),
    ("lgpl-3.0", _foundation("gnu lesser general public license", "3"), ("gnu lesser general public license", "either version 3")),
    ("agpl-3.0", _foundation("gnu affero general public license", "3"), ("gnu affero general public license", "either version 3")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at http mozilla org mpl 2 0""", ("mozilla public license v 2 0",)),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
     ("unencumbered software released into the public domain",)),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
alter it and redistribute it freely""", ("alter it and redistribute it freely",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
]

#: Creative Commons licences: their short names, in lines of one form for every version.
NOTICES += [
    (f"cc-{kind.replace(' ', '-')}-{version.replace(' ', '.')}", f"licensed under cc {kind} {version}", (f"cc {kind} {version}",))
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for version in ("2 0", "3 0", "4 0")
]
