"""Dimension tables: tag maps, tag semantics, format priorities, loaders and small lookups.

All are fixed values of the formats, small by nature, and are broadcast.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Native tag = common tag.
_ID3V1 = """
title = title
artist = artist
album = album
year = year
comment = comment
track = track
genre = genre
"""

# Native tag = common tag.
_ID3V2 = """
TT2 = title
TIT2 = title
TP1 = artist
TPE1 = artist
TP2 = albumartist
TPE2 = albumartist
TAL = album
TALB = album
TYE = year
TYER = year
TDRC = date
TDOR = originaldate
TRK = track
TRCK = track
TPA = disk
TPOS = disk
TCO = genre
TCON = genre
COM = comment
COMM = comment
TSOT = titlesort
TSOA = albumsort
TSOP = artistsort
TSO2 = albumartistsort
TCOM = composer
TEXT = lyricist
TENC = encoder
TPUB = publisher
TIT1 = grouping
TMOO = mood
MVIN = movementindex
PCST = podcast
PCS = podcastid
TLAN = language
TCOP = copyright
"""

# Native tag = common tag.
_VORBIS = """
TITLE = title
ARTIST = artist
ARTISTS = artists
ALBUM = album
DATE = date
TRACKNUMBER = track
TRACKTOTAL = totaltracks
TOTALTRACKS = totaltracks
DISCNUMBER = disk
DISCTOTAL = totaldiscs
TOTALDISCS = totaldiscs
GENRE = genre
STYLE = genre
ALBUMARTIST = albumartist
ALBUM ARTIST = albumartist
METADATA_BLOCK_PICTURE = picture
"""

# Native tag = common tag.
_ITUNES = """
©nam = title
©art = artist
aart = albumartist
----:com.apple.itunes:band = albumartist
©alb = album
©day = date
©cmt = comment
©com = comment
trkn = track
disk = disk
©gen = genre
gnre = genre
covr = picture
©wrt = composer
©lyr = lyrics
cpil = compilation
tmpo = bpm
pgap = gapless
tvsh = tvShow
tvsn = tvSeason
tves = tvEpisode
sosn = tvShowSort
tven = tvEpisodeId
tvnn = tvNetwork
pcst = podcast
purl = podcasturl
©too = encodedby
cprt = copyright
©cpy = copyright
stik = stik
rate = rating
©grp = grouping
soal = albumsort
sonm = titlesort
soar = artistsort
soaa = albumartistsort
soco = composersort
©wrk = work
©mvn = movement
©mvi = movementIndex
©mvc = movementTotal
keyw = keywords
catg = category
hdvd = hdVideo
shwm = showMovement
egid = podcastId
----:com.apple.itunes:lyricist = lyricist
----:com.apple.itunes:conductor = conductor
----:com.apple.itunes:remixer = remixer
----:com.apple.itunes:engineer = engineer
----:com.apple.itunes:producer = producer
----:com.apple.itunes:djmixer = djmixer
----:com.apple.itunes:mixer = mixer
----:com.apple.itunes:label = label
----:com.apple.itunes:subtitle = subtitle
----:com.apple.itunes:discsubtitle = discsubtitle
----:com.apple.itunes:mood = mood
----:com.apple.itunes:media = media
----:com.apple.itunes:catalognumber = catalognumber
----:com.apple.itunes:language = language
----:com.apple.itunes:script = script
----:com.apple.itunes:license = license
----:com.apple.itunes:barcode = barcode
----:com.apple.itunes:isrc = isrc
----:com.apple.itunes:asin = asin
----:com.apple.itunes:notes = comment
----:com.apple.itunes:musicbrainz track id = musicbrainz_recordingid
----:com.apple.itunes:musicbrainz release track id = musicbrainz_trackid
----:com.apple.itunes:musicbrainz album id = musicbrainz_albumid
----:com.apple.itunes:musicbrainz artist id = musicbrainz_artistid
----:com.apple.itunes:musicbrainz album artist id = musicbrainz_albumartistid
----:com.apple.itunes:musicbrainz release group id = musicbrainz_releasegroupid
----:com.apple.itunes:musicbrainz work id = musicbrainz_workid
----:com.apple.itunes:musicbrainz trm id = musicbrainz_trmid
----:com.apple.itunes:musicbrainz disc id = musicbrainz_discid
----:com.apple.itunes:acoustid id = acoustid_id
----:com.apple.itunes:acoustid fingerprint = acoustid_fingerprint
"""

# Native tag = common tag.
_APEV2 = """
Title = title
Artist = artist
Artists = artists
Album Artist = albumartist
Album = album
Year = year
Originalyear = originalyear
Originaldate = originaldate
Releasedate = releasedate
Comment = comment
Track = track
Disc = disk
DISCNUMBER = disk
Genre = genre
Cover Art (Front) = picture
Cover Art (Back) = picture
Composer = composer
Lyricist = lyricist
Writer = writer
Conductor = conductor
MixArtist = remixer
Arranger = arranger
Engineer = engineer
Producer = producer
DJMixer = djmixer
Mixer = mixer
Label = label
Grouping = grouping
Subtitle = subtitle
DiscSubtitle = discsubtitle
Compilation = compilation
BPM = bpm
Mood = mood
Media = media
CatalogNumber = catalognumber
MUSICBRAINZ_ALBUMSTATUS = releasestatus
MUSICBRAINZ_ALBUMTYPE = releasetype
RELEASECOUNTRY = releasecountry
Script = script
Language = language
Copyright = copyright
LICENSE = license
EncodedBy = encodedby
EncoderSettings = encodersettings
Barcode = barcode
ISRC = isrc
ASIN = asin
musicbrainz_trackid = musicbrainz_recordingid
musicbrainz_releasetrackid = musicbrainz_trackid
MUSICBRAINZ_ALBUMID = musicbrainz_albumid
MUSICBRAINZ_ARTISTID = musicbrainz_artistid
MUSICBRAINZ_ALBUMARTISTID = musicbrainz_albumartistid
MUSICBRAINZ_RELEASEGROUPID = musicbrainz_releasegroupid
MUSICBRAINZ_WORKID = musicbrainz_workid
MUSICBRAINZ_TRMID = musicbrainz_trmid
MUSICBRAINZ_DISCID = musicbrainz_discid
Acoustid_Id = acoustid_id
ACOUSTID_FINGERPRINT = acoustid_fingerprint
MUSICIP_PUID = musicip_puid
Weblink = website
"""

# Native tag = common tag.
_ASF = """
Title = title
Author = artist
WM/AlbumArtist = albumartist
WM/AlbumTitle = album
WM/Year = date
WM/OriginalReleaseTime = originaldate
WM/OriginalReleaseYear = originalyear
Description = comment
WM/TrackNumber = track
WM/PartOfSet = disk
WM/Genre = genre
WM/Composer = composer
WM/Lyrics = lyrics
WM/AlbumSortOrder = albumsort
WM/TitleSortOrder = titlesort
WM/ArtistSortOrder = artistsort
WM/AlbumArtistSortOrder = albumartistsort
WM/ComposerSortOrder = composersort
WM/Writer = lyricist
WM/Conductor = conductor
WM/ModifiedBy = remixer
WM/Engineer = engineer
WM/Producer = producer
WM/DJMixer = djmixer
WM/Mixer = mixer
WM/Publisher = label
WM/ContentGroupDescription = grouping
WM/SubTitle = subtitle
WM/SetSubTitle = discsubtitle
WM/IsCompilation = compilation
WM/SharedUserRating = rating
WM/BeatsPerMinute = bpm
WM/Mood = mood
WM/Media = media
WM/CatalogNo = catalognumber
MusicBrainz/Album Status = releasestatus
MusicBrainz/Album Type = releasetype
MusicBrainz/Album Release Country = releasecountry
WM/Script = script
WM/Language = language
Copyright = copyright
LICENSE = license
WM/EncodedBy = encodedby
WM/EncodingSettings = encodersettings
WM/Barcode = barcode
WM/ISRC = isrc
MusicBrainz/Track Id = musicbrainz_recordingid
MusicBrainz/Release Track Id = musicbrainz_trackid
MusicBrainz/Album Id = musicbrainz_albumid
MusicBrainz/Artist Id = musicbrainz_artistid
MusicBrainz/Album Artist Id = musicbrainz_albumartistid
MusicBrainz/Release Group Id = musicbrainz_releasegroupid
MusicBrainz/Work Id = musicbrainz_workid
MusicBrainz/TRM Id = musicbrainz_trmid
MusicBrainz/Disc Id = musicbrainz_discid
Acoustid/Id = acoustid_id
Acoustid/Fingerprint = acoustid_fingerprint
MusicIP/PUID = musicip_puid
WM/ARTISTS = artists
WM/InitialKey = key
ASIN = asin
WM/Work = work
WM/AuthorURL = website
WM/Picture = picture
"""

# Native tag = common tag.
_MATROSKA = """
segment:title = title
album:ARTIST = albumartist
album:ARTISTSORT = albumartistsort
album:TITLE = album
album:DATE_RECORDED = originaldate
album:DATE_RELEASED = releasedate
album:PART_NUMBER = disk
album:TOTAL_PARTS = totaltracks
track:ARTIST = artist
track:ARTISTSORT = artistsort
track:TITLE = title
track:PART_NUMBER = track
track:MUSICBRAINZ_TRACKID = musicbrainz_recordingid
track:MUSICBRAINZ_ALBUMID = musicbrainz_albumid
track:MUSICBRAINZ_ARTISTID = musicbrainz_artistid
track:PUBLISHER = label
track:GENRE = genre
track:ENCODER = encodedby
track:ENCODER_OPTIONS = encodersettings
edition:TOTAL_PARTS = totaldiscs
picture = picture
"""

# Native tag = common tag.
_EXIF = """
IART = artist
ICRD = date
INAM = title
TITL = title
IPRD = album
IRPD = album
ITRK = track
IPRT = track
COMM = comment
ICMT = comment
ICNT = releasecountry
GNRE = genre
IGNR = genre
IWRI = writer
RATE = rating
YEAR = year
ISFT = encodedby
CODE = encodedby
TURL = website
IENG = engineer
ITCH = technician
IMED = media
"""

# Native tag = common tag.
_AIFF = """
NAME = title
AUTH = artist
(c)  = copyright
ANNO = comment
"""

MAPS = {"ID3v1": _ID3V1, "ID3v2.2": _ID3V2, "ID3v2.3": _ID3V2, "ID3v2.4": _ID3V2, "vorbis": _VORBIS, "iTunes": _ITUNES, "APEv2": _APEV2, "asf": _ASF, "matroska": _MATROSKA, "exif": _EXIF, "AIFF": _AIFF}

# How often a common tag may stand, and whether a list keeps repeated values.
SINGLETON = """
title, artist, album, albumartist, year, date, originaldate, originalyear, releasedate, track, disk, totaltracks, totaldiscs, titlesort, artistsort,
albumsort, albumartistsort, composersort, grouping, discsubtitle, compilation, work, media, bpm, key, mood, averagelevel, peaklevel, copyright,
license, encodedby, encodersettings, gapless, barcode, asin, musicbrainz_recordingid, musicbrainz_trackid, musicbrainz_albumid,
musicbrainz_releasegroupid, musicbrainz_workid, musicbrainz_trmid, musicbrainz_discid, acoustid_id, acoustid_fingerprint, musicip_puid,
musicip_fingerprint, discogs_release_id, discogs_label_id, discogs_master_release_id, discogs_votes, discogs_rating, replaygain_track_gain,
replaygain_track_peak, replaygain_album_gain, replaygain_album_peak, replaygain_track_minmax, replaygain_album_minmax, replaygain_undo, tvshow,
tvshowsort, tvseason, tvepisode, tvepisodeid, tvnetwork, hdvideo, podcast, podcasturl, podcastid, releasestatus, releasecountry, originalalbum,
originalartist, script, language, longdescription, website, movement, movementindex, movementtotal, showmovement, stik, playcounter
"""
LIST_UNIQUE = """
artists, albumartists, genre, picture, composer, lyricist, writer, conductor, remixer, arranger, engineer, technician, producer, djmixer, mixer,
publisher, label, catalognumber, discogs_artist_id, performer:instrument
"""
LIST_ALL = """
comment, lyrics, subtitle, rating, isrc, musicbrainz_artistid, musicbrainz_albumartistid, releasetype, description, notes, category, keywords
"""

# Genres by number.
GENRES = """
Blues; Classic Rock; Country; Dance; Disco; Funk; Grunge; Hip-Hop; Jazz; Metal; New Age; Oldies; Other; Pop; R&B; Rap; Reggae; Rock; Techno;
Industrial; Alternative; Ska; Death Metal; Pranks; Soundtrack; Euro-Techno; Ambient; Trip-Hop; Vocal; Jazz+Funk; Fusion; Trance; Classical;
Instrumental; Acid; House; Game; Sound Clip; Gospel; Noise; Alt. Rock; Bass; Soul; Punk; Space; Meditative; Instrumental Pop; Instrumental Rock;
Ethnic; Gothic; Darkwave; Techno-Industrial; Electronic; Pop-Folk; Eurodance; Dream; Southern Rock; Comedy; Cult; Gangsta Rap; Top 40; Christian Rap;
Pop/Funk; Jungle; Native American; Cabaret; New Wave; Psychedelic; Rave; Showtunes; Trailer; Lo-Fi; Tribal; Acid Punk; Acid Jazz; Polka; Retro;
Musical; Rock & Roll; Hard Rock; Folk; Folk/Rock; National Folk; Swing; Fast-Fusion; Bebob; Latin; Revival; Celtic; Bluegrass; Avantgarde; Gothic
Rock; Progressive Rock; Psychedelic Rock; Symphonic Rock; Slow Rock; Big Band; Chorus; Easy Listening; Acoustic; Humour; Speech; Chanson; Opera;
Chamber Music; Sonata; Symphony; Booty Bass; Primus; Porn Groove; Satire; Slow Jam; Club; Tango; Samba; Folklore; Ballad; Power Ballad; Rhythmic Soul;
Freestyle; Duet; Punk Rock; Drum Solo; A Cappella; Euro-House; Dance Hall; Goa; Drum & Bass; Club-House; Hardcore; Terror; Indie; BritPop; Negerpunk;
Polsk Punk; Beat; Christian Gangsta Rap; Heavy Metal; Black Metal; Crossover; Contemporary Christian; Christian Rock; Merengue; Salsa; Thrash Metal;
Anime; JPop; Synthpop; Abstract; Art Rock; Baroque; Bhangra; Big Beat; Breakbeat; Chillout; Downtempo; Dub; EBM; Eclectic; Electro; Electroclash; Emo;
Experimental; Garage; Global; IDM; Illbient; Industro-Goth; Jam Band; Krautrock; Leftfield; Lounge; Math Rock; New Romantic; Nu-Breakz; Post-Punk;
Post-Rock; Psytrance; Shoegaze; Space Rock; Trop Rock; World Music; Neoclassical; Audiobook; Audio Theatre; Neue Deutsche Welle; Podcast; Indie Rock;
G-Funk; Dubstep; Garage Rock; Psybient
"""

# Priority of a tag format; others have 0.
PRIORITY = {"ID3v1": 1, "ID3v2.2": 2, "ID3v2.3": 3, "ID3v2.4": 4}

# Loader | extensions | MIME types | needs a seekable source | tag formats it maps. The last registration of a key wins.
_LOADERS = """
flac | flac | audio/flac audio/x-flac | yes | vorbis
mp4 | mp4 m4a m4b m4p m4r m4v | audio/mp4 video/mp4 audio/x-m4a | yes | iTunes
ogg | ogg oga ogv opus | audio/ogg application/ogg audio/vorbis audio/opus | no | vorbis
wav | wav wave | audio/wav audio/x-wav audio/wave | yes | exif ID3v2.2 ID3v2.3 ID3v2.4
aiff | aiff aif aifc | audio/aiff audio/x-aiff sound/aiff | yes | AIFF ID3v2.2 ID3v2.3 ID3v2.4
asf | asf wma wmv | audio/x-ms-wma audio/x-ms-asf video/x-ms-asf application/vnd.ms-asf audio/ms-wma video/ms-wmv audio/ms-asf video/ms-asf | no | asf
apev2 | ape apev2 | audio/ape audio/x-ape | yes | APEv2
matroska | mka mkv mk3d mks webm | audio/matroska video/matroska audio/webm video/webm | yes | matroska
musepack | mpc mp+ mpk mka | audio/x-musepack audio/musepack video/x-musepack video/webm | yes | APEv2 matroska
wavpack | wv wvp | audio/wavpack | yes | APEv2
dsf | dsf | audio/dsf | no | ID3v2.2 ID3v2.3 ID3v2.4
dsdiff | dff | audio/dsd | no | ID3v2.2 ID3v2.3 ID3v2.4
id3v2 | mp3 | audio/mpeg audio/mp3 | no | ID3v2.2 ID3v2.3 ID3v2.4
mpeg | mp2 mp3 m2a aac aacp | audio/mpeg audio/mp3 audio/aacs audio/aacp | no | ID3v1 ID3v2.2 ID3v2.3 ID3v2.4
"""

# MIME type guessed from an extension.
MIME_OF_EXTENSION = {"mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "mp4": "audio/mp4", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac", "opus": "audio/opus", "wma": "audio/x-ms-wma", "ape": "audio/x-ape"}


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" = ")) for line in text.strip("\n").split("\n")]  # type: ignore[misc]


def _list(text: str, sep: str = ",") -> list[str]:
    return [x.strip() for x in text.replace("\n", " ").strip().split(sep)]


def tag_map_rows() -> tuple[tuple[str, str, str], ...]:
    """(format_id, native tag in lower case, common tag)."""
    return tuple(r for r in _fixed_map() if r[0] not in _ADDED_MAPS) + tuple((f, native, common) for f, tags in _ADDED_MAPS.items() for native, common in tags.items())


@cache
def _fixed_map() -> tuple[tuple[str, str, str], ...]:
    return tuple((f, native.lower(), common) for f, text in MAPS.items() for native, common in _pairs(text))


@cache
def semantics_rows() -> tuple[tuple[str, bool, bool], ...]:
    """(common tag, is it a singleton, does a list drop repeated values)."""
    return tuple([(t, True, False) for t in _list(SINGLETON)] + [(t, False, True) for t in _list(LIST_UNIQUE)] + [(t, False, False) for t in _list(LIST_ALL)])


def genres() -> list[str]:
    return _list(GENRES, ";")


#: Registrations of a session, behind the fixed ones: (kind, key, loader, needs seek).
_ADDED: list[tuple[str, str, str, bool]] = []
#: Tag maps of a session, over the fixed ones: format -> {native tag in lower case: common tag}.
_ADDED_MAPS: dict[str, dict[str, str]] = {}


def register_loader(loader: str, extensions: tuple[str, ...] = (), mime_types: tuple[str, ...] = (), needs_seek: bool = False) -> None:
    """Files with these keys go to ``loader``, whatever was registered for the keys before."""
    _ADDED.extend([("ext", e.lower().lstrip("."), loader, needs_seek) for e in extensions] + [("mime", m, loader, needs_seek) for m in mime_types])


def register_mapper(format_id: str, tags: dict[str, str]) -> None:
    """Common tags of the native tags of a format; replaces the map of a format that has one."""
    _ADDED_MAPS[format_id] = {k.lower(): v for k, v in tags.items()}


def clear_registered() -> None:
    """Forgets what a session registered."""
    _ADDED.clear()
    _ADDED_MAPS.clear()


def loader_rows() -> tuple[tuple[str, str, str, bool, int], ...]:
    """(kind 'ext' or 'mime', key, loader, needs seek, registration number), one row per registration."""
    fixed = _fixed_loaders()
    return fixed + tuple((*r, 1000 + n) for n, r in enumerate(_ADDED))


@cache
def _fixed_loaders() -> tuple[tuple[str, str, str, bool, int], ...]:
    rows = []
    for n, line in enumerate(_LOADERS.strip().split("\n")):
        name, ext, mime, seek, _ = [x.strip() for x in line.split("|")]
        rows += [("ext", e, name, seek == "yes", n) for e in ext.split()] + [("mime", m, name, seek == "yes", n) for m in mime.split()]
    return tuple(rows)


def loader_formats() -> dict[str, list[str]]:
    """Tag formats that each loader maps; others stay native."""
    return {x[0].strip(): x[4].split() for x in (line.split("|") for line in _LOADERS.strip().split("\n"))}


def tag_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(tag_map_rows()), "format_id string, native_lower string, common_id string")


def tag_semantics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(semantics_rows()), "common_lower string, is_singleton boolean, is_unique boolean")


def format_priority(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRIORITY.items()), "format_id string, priority int")


def parser_registry(spark: SparkSession) -> DataFrame:
    """kind, key, loader, needs_seek: the owner of every key, the last registration winning."""
    last = {(k, key): (loader, seek) for k, key, loader, seek, _ in loader_rows()}
    return spark.createDataFrame([(k, key, loader, seek) for (k, key), (loader, seek) in last.items()], "kind string, key string, loader string, needs_seek boolean")


def sql_values(rows, columns: str) -> str:
    """A VALUES list of fixed rows for a SQL text: ``(VALUES ...) AS t(columns)``."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS {columns}"
