"""License notices and whole license texts, each wording under a name of its own."""

# Texts as they stand in files.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software"
)
_MIT = (
    f"{_MIT_GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met"
)
_BSD_SOURCE = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer."
)
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at"
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation"
)


def _gnu(what: str, name: str, version: str) -> str:
    """The notice that files under a GNU license carry."""
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
        f"as published by the Free Software Foundation, either version {version} of the License, or (at your "
        f"option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        f"the GNU {name} for more details. You should have received a copy of the GNU {name} along with this "
        f"{what}."
    )


def _creative_commons(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} International License."


TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", _MIT_GRANT),
    ("Apache-2.0-notice", _APACHE),
    ("GPL-notice", _GPL),
    ("BSD-notice", _BSD),
    ("ISC-notice", _ISC),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-text", f"{_MIT} {_MIT_WARRANTY}"),
    ("MIT-0-text", f"{_MIT_GRANT}, and to permit persons to whom the Software is furnished to do so. {_MIT_WARRANTY}"),
    ("BSD-2-Clause-text", f"{_BSD}: {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("BSD-2-Clause-numbered-text", f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("BSD-3-Clause-text", f"{_BSD}: {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAME} {_BSD_WARRANTY}"),
    ("BSD-3-Clause-numbered-text", f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAME} {_BSD_WARRANTY}"),
    ("ISC-text", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. "
     f"{_ISC_WARRANTY}"),
    ("0BSD-text", f"{_ISC}. {_ISC_WARRANTY}"),
    ("Apache-2.0-text", f"{_APACHE} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
     "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("MPL-2.0-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
     "of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
     "authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
     "to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
     "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
     "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
     "in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
     "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not "
     "be removed or altered from any source distribution."),
    ("Unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to "
     "copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
     "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL-text", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, "
     "and changing it is allowed as long as the name is changed."),
    *((f"{short}-{version}-{what}-text", _gnu(what, f"{name} Public License", version))
      for short, name, versions in (
          ("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",)))
      for version in versions for what in ("program", "library")),
    *((f"CC-{short}-4.0-text", _creative_commons(f"{name} 4.0"))
      for short, name in (
          ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
          ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
]
