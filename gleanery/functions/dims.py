"""Small fixed tables: finding kinds, removal contract, suffixes, names that are not people, shorteners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The codes of finding kinds, in category order.
KINDS = """covered hiddentext location qrwifi qrsecret qrtrick qrplace authclaim replyto linkmismatch linkidn riskyfile
sentfrom computer downloaded folder updates deleted earlier form attachments weblinks qrcontact qrlink qrtext returnpath
mailer timezone embedded hiddensheets hiddencells notes hiddenslides links photoplace serial owner author editor manager
company label comments tracked photo camera shutter linked uptime place original caption lens taken created modified
editing revisions history prompt ai credentials software application producer template custom printer printed title
artist album album-artist year track disc genre composer encoder organization audio-tag subject keywords description tags
thumbnail paths account emails names toolchain language imports sourcemap debug category status encryption screenshot
copyright engineer originator broadcast-reference opens scripts launch submits sdk debuginfo""".split()

# Kinds whose removal a clean copy can prove, with the formats in which it can.
PROVEN = """
covered: pdf
hiddentext: pdf
location: jpeg png webp heif tiff video flac ogg
downloaded: zip
folder: zip
deleted: zip rtf
attachments: pdf
embedded: svg
links: svg
photoplace: zip svg
serial: jpeg png webp heif tiff
owner: jpeg png webp heif tiff video
author: pdf zip office97 rtf svg
editor: zip office97 rtf
manager: zip office97 rtf
company: zip office97 rtf svg
label: zip
comments: pdf rtf
tracked: zip rtf
photo: zip
camera: jpeg png webp heif tiff video
place: wav
original: svg
caption: png
lens: jpeg png webp heif tiff
taken: jpeg png webp heif tiff video
created: pdf zip office97 rtf svg wav
modified: pdf zip office97 rtf
editing: zip office97 rtf
revisions: zip office97 rtf
history: pdf wav
prompt: png
ai: png
software: jpeg png webp heif tiff video svg wav
application: pdf zip office97 rtf
producer: pdf
template: zip office97 rtf
custom: zip rtf
printer: zip
printed: zip rtf
title: pdf zip office97 rtf svg mp3 flac ogg wav
artist: mp3 flac ogg wav
album: mp3 flac ogg wav
album-artist: mp3 flac ogg
year: mp3 flac ogg
track: mp3 flac ogg wav
disc: mp3 flac ogg
genre: mp3 flac ogg
composer: mp3 flac ogg
encoder: mp3 flac ogg
organization: flac ogg
audio-tag: mp3 flac ogg wav
subject: pdf zip office97 rtf wav
keywords: pdf zip office97 rtf svg wav
description: zip office97 rtf svg wav
tags: zip
thumbnail: jpeg webp zip
category: zip office97 rtf
status: zip
copyright: wav
engineer: wav
originator: wav
broadcast-reference: wav
account: text
emails: text
addresses: text
"""
REMOVABLE: dict[str, list[str]] = {}
for _line in PROVEN.split("\n")[1:-1]:
    _kind, _, _formats = _line.partition(": ")
    for _format in _formats.split():
        REMOVABLE.setdefault(_format, []).append(_kind)

# Accounts that are nobody's, and what only looks like a domain.
NOT_PEOPLE = ["shared", "public", "default", "default user", "all users", "runner", "root", "user", "username"]
NOT_DOMAINS = "png jpg jpeg gif svg webp pdf js css json xml html txt md".split()

# Suffixes under which anyone registers a name of their own.
SHARED_SUFFIXES = """com.ua org.ua net.ua in.ua gov.ua edu.ua biz.ua co.ua pp.ua kiev.ua kyiv.ua lviv.ua od.ua odesa.ua dp.ua kh.ua
kharkov.ua zp.ua dn.ua if.ua te.ua vn.ua cn.ua ck.ua pl.ua sm.ua rv.ua lg.ua mk.ua ks.ua uz.ua km.ua kr.ua zt.ua lt.ua cv.ua
lutsk.ua dnipro.ua co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk com.au net.au org.au gov.au edu.au co.nz org.nz govt.nz
co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ne.kr ac.kr com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn com.tr org.tr gov.tr
com.pl net.pl org.pl com.mx org.mx co.in net.in org.in gov.in co.za org.za com.ar com.sg com.hk co.il org.il com.tw co.at or.at
com.es com.pt co.id com.ph com.vn co.th com.sa com.eg com.ng co.ke com.pk com.co com.pe""".split()

# Short-link services.
SHORTENERS = """bit.ly t.co tinyurl.com goo.gl ow.ly buff.ly is.gd rb.gy cutt.ly shorturl.at s.id t.ly tiny.cc rebrand.ly
qrco.de qr.link lnkd.in bl.ink short.io surl.li""".split()

# Extensions of files that run, open sites or carry programs; and those they pose as.
RISKY = {
    "page": "html htm shtml xhtml svg".split(),
    "program": "exe scr com pif msi bat cmd ps1 vbs vbe js jse wsf hta jar app command sh".split(),
    "shortcut": ["lnk", "url"], "disk": "iso img vhd vhdx".split(), "macros": "docm xlsm pptm".split(),
}
POSED = "pdf doc docx xls xlsx jpg jpeg png txt zip".split()


def finding_kinds(spark: SparkSession) -> DataFrame:
    """``kind``, ``position``: about a hundred rows, always small enough to broadcast."""
    return spark.createDataFrame(list(zip(KINDS, range(len(KINDS)))), "kind string, position int")


def removal_contract(spark: SparkSession) -> DataFrame:
    """``format``, ``kind``, ``scope`` of removals that can be verified."""
    return spark.createDataFrame([(f, k, "file") for f, ks in REMOVABLE.items() for k in ks], "format string, kind string, scope string")
