"""Texts of common licences, and notices that put a work under one (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """A text to recognise: its label, phrases that a copy must have and must not have, and the least share of its words in order."""

    label: str
    text: str
    must: tuple[str, ...]
    never: tuple[str, ...] = ()
    least: float = 0.6


BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU_NOTICE = """{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
{name} Public License for more details. You should have received a copy of the GNU {name} Public License along with this {kind}."""


def gnu(label: str, name: str, version: str, it: str = "This program", kind: str = "program") -> Template:
    text = GNU_NOTICE.format(it=it, name=name, version=version, kind=kind)
    return Template(label, text, (f"GNU {name} Public License as published by", f"version {version} of the License"))


#: Licence texts and the notices that their authors give for use in files.
TEXTS = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""", ("Permission is hereby granted free of charge to any person obtaining a copy", "without restriction")),
    Template("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright
notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included
in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the
form of machine-executable object code generated by a source language processor.""", ("to any person or organization obtaining a copy",)),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("for any purpose with or without fee is hereby granted",)),
    Template("bsd-2", f"{BSD_START} {BSD_END}", ("Redistribution and use in source and binary forms", "following conditions are met"), ("Neither the name",)),
    Template("bsd-3", f"{BSD_START} {BSD_NAMES} {BSD_END}", ("Redistribution and use in source and binary forms", "following conditions are met", "Neither the name")),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. This notice may not be removed or altered from any source distribution.""", ("origin of this software must not be misrepresented",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means.""", ("free and unencumbered software released into the public domain",)),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
the License for the specific language governing permissions and limitations under the License.""", ("Apache License Version 2.0", "in compliance with the License")),
    Template("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("Mozilla Public License",)),
    gnu("gpl-2", "General", "2"),
    gnu("gpl-3", "General", "3"),
    gnu("lgpl-2.1", "Lesser General", "2.1", "This library", "library"),
    gnu("lgpl-3", "Lesser General", "3", "This library", "library"),
    gnu("agpl-3", "Affero General", "3"),
    Template("cc0-1", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
        ("waived all copyright and related or neighboring rights",)),
)
#: Full names of licences, for notices of the form "licensed under the NAME".
NAMES = (
    ("mit", "MIT License"), ("bsd-2", "BSD 2-Clause License"), ("bsd-3", "BSD 3-Clause License"), ("isc", "ISC License"), ("zlib", "zlib License"),
    ("bsl-1", "Boost Software License 1.0"), ("apache-2", "Apache License Version 2.0"), ("mpl-2", "Mozilla Public License Version 2.0"),
    ("epl-2", "Eclipse Public License Version 2.0"), ("gpl-2", "GNU General Public License Version 2"), ("gpl-3", "GNU General Public License Version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License Version 2.1"), ("lgpl-3", "GNU Lesser General Public License Version 3"),
    ("agpl-3", "GNU Affero General Public License Version 3"), ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)
TEMPLATES = TEXTS + tuple(Template(label, f"licensed under the {name}", (name,), least=0.8) for label, name in NAMES)
