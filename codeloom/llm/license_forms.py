"""The forms in which licences usually stand in files: short full texts, headers, titles.

Fixed values. Long licences are known by their titles, which stand on top of the text.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    license: str
    text: str


_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_MIT_NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    f"conditions: {_MIT_NOTICE} "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_FIRST = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at"
)
_APACHE = (
    f"{_APACHE_FIRST} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)


def _gnu(license: str, name: str, version: str, date: str, merchantability: str = "MERCHANTABILITY or") -> tuple[Template, ...]:
    """The header in both ways of its version, each whole and its first sentence, and the title."""
    given = "This program is free software: you can redistribute it and/or modify it under the terms of the"
    later = (
        f"{given} GNU {name} as published by the Free Software Foundation, either version {version} of the License, "
        "or (at your option) any later version."
    )
    only = f"{given} GNU {name} version {version} as published by the Free Software Foundation."
    rest = (
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of {merchantability} FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more "
        f"details. You should have received a copy of the GNU {name} along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    )
    title = f"GNU {name} Version {version}, {date}"
    return tuple(Template(license, text) for text in (later + rest, only + rest, later, only, title, f"GNU {name} version {version}"))


FORMS = (
    Template("Apache-2.0", _APACHE),
    Template("Apache-2.0", _APACHE_FIRST),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    Template("BSD-2-Clause", _BSD_2 + _AS_IS),
    Template("BSD-2-Clause", "BSD 2-Clause License"),
    Template("BSD-3-Clause", _BSD_2 + _BSD_3 + _AS_IS),
    Template("BSD-3-Clause", "BSD 3-Clause License"),
    Template("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("ISC", _ISC),
    Template("MIT", _MIT),
    Template("MIT", _MIT_NOTICE),
    Template("MIT", "The MIT License (MIT)"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("MPL-2.0", "Mozilla Public License Version 2.0"),
    *_gnu("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
    *_gnu("GPL-2.0", "General Public License", "2", "June 1991"),
    *_gnu("GPL-3.0", "General Public License", "3", "29 June 2007"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
)
