"""Small tables that results depend on."""

from __future__ import annotations

# Name, lon_min, lon_max, lat_min, lat_max, lat_offset, lon_offset. The order decides ties.
REGIONS = [
    ("Skagerrak_Väst", 10.3, 11.5, 57.5, 59.0, -0.055, -0.008),
    ("Skagerrak_Öst", 11.5, 12.5, 57.5, 59.0, -0.053, -0.005),
    ("Kattegatt_Nord", 11.0, 12.8, 56.5, 57.5, -0.052, -0.003),
    ("Kattegatt_Syd", 11.5, 13.0, 55.5, 56.5, -0.050, -0.001),
    ("Öresund_Nord", 12.5, 13.2, 55.8, 56.3, -0.049, 0.001),
    ("Öresund_Syd", 12.8, 13.1, 55.4, 55.8, -0.052, 0.000),
    ("Skåne_Sydkust", 13.0, 14.5, 54.9, 55.6, -0.048, 0.002),
    ("Östersjön_Sydväst", 13.5, 15.0, 55.0, 56.5, -0.051, 0.003),
    ("Östersjön_Bornholm", 14.5, 16.0, 55.0, 56.0, -0.047, 0.005),
    ("Hanöbukten", 13.8, 15.2, 55.8, 56.5, -0.050, 0.004),
    ("Blekinge_Kust", 14.0, 16.0, 56.0, 56.8, -0.049, 0.006),
    ("Kalmar_Sund", 15.8, 16.6, 56.5, 57.8, -0.048, 0.008),
    ("Gotland_Väst", 17.5, 18.5, 56.8, 57.8, -0.045, 0.012),
    ("Gotland_Öst", 18.5, 19.5, 56.8, 57.8, -0.043, 0.015),
    ("Stockholm_Inre_Skärgård", 18.0, 19.0, 59.0, 59.6, -0.046, 0.010),
    ("Stockholm_Yttre_Skärgård", 18.5, 19.5, 58.8, 59.2, -0.044, 0.012),
    ("Södermanland_Kust", 16.5, 18.0, 58.5, 59.3, -0.047, 0.008),
    ("Uppland_Kust", 17.0, 18.5, 59.3, 60.2, -0.045, 0.009),
    ("Gävleborg_Syd", 16.5, 18.0, 60.0, 61.0, -0.043, 0.007),
    ("Bottenhavet_Syd", 17.0, 19.0, 60.5, 61.5, -0.042, 0.008),
    ("Bottenhavet_Nord", 17.5, 19.5, 61.5, 62.5, -0.040, 0.010),
    ("Bottenviken_Syd", 18.0, 20.0, 62.5, 63.5, -0.038, 0.012),
    ("Bottenviken_Nord", 18.5, 20.5, 63.5, 65.0, -0.035, 0.015),
    ("Västkusten_Göteborg", 11.5, 12.5, 57.5, 58.2, -0.054, -0.004),
    ("Västkusten_Halland", 12.0, 13.0, 56.0, 57.0, -0.053, -0.002),
    ("Default_Östersjön", 10.3, 16.6, 54.9, 59.6, -0.052, 0.000),
]

# Lat, lon, name.
CONTROL_POINTS = [
    (56.030646, 12.676845, "Öresund Nord"),
    (56.075782, 12.571651, "Öresund Väst"),
    (56.050565, 12.611470, "Öresund Central 1"),
    (56.020683, 12.685760, "Öresund Öst"),
    (56.089047, 12.629894, "Öresund Central 2"),
    (56.006397, 12.602555, "Öresund Syd"),
    (55.995430, 12.656638, "Öresund Sydöst"),
    (56.092031, 12.584726, "Öresund Nordväst"),
    (56.047029, 12.677629, "Öresund Central 3"),
    (56.066859, 12.659960, "Öresund Central 4"),
    (56.095156, 12.615138, "Öresund Central 5"),
]

# Colour ramps, as value and hex colour.
RAMPS = {
    "current": [
        (0.0, "#000080"), (0.1, "#0080FF"), (0.2, "#00FF80"), (0.4, "#80FF00"), (0.6, "#FFFF00"),
        (0.8, "#FF8000"), (1.0, "#FF4000"), (1.1, "#FF0000"), (1.2, "#800000"), (1.3, "#400000"),
    ],
    "temperature": [
        (-1.0, "#000080"), (2.0, "#0066FF"), (8.0, "#00AA00"), (12.0, "#FFFF00"), (16.0, "#FF8800"), (24.0, "#FF0000"),
    ],
    "salinity": [(0.0, "#004400"), (8.0, "#00BB00"), (16.0, "#FFFF00"), (24.0, "#66CCFF"), (36.0, "#000066")],
}
ARROW_COLOURS, ARROW_TOP = ["#0000ff", "#00ffff", "#00ff00", "#ffff00", "#ff0000"], 0.7

# Unit, name, English name and folder of each parameter.
PARAMETERS = {
    "current": ("m/s", "strömstyrka", "current_magnitude", "current-magnitude-images"),
    "temperature": ("°C", "vattentemperatur", "temperature", "temperature-images"),
    "salinity": ("g/kg", "salthalt", "salinity", "salinity-images"),
}

# Bounding box of the rasters, and upper ends of the speed bins in knots.
LON_MIN, LON_MAX, LAT_MIN, LAT_MAX = 10.3, 16.6, 54.9, 59.6
KNOT_BINS = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5]
KNOTS, KM_PER_DEGREE, EARTH_KM = 1.944, 111.0, 6371.0

# Colours of past and future hours, as share of the range and red, green, blue.
PAST = [(0.0, 255, 223, 0), (0.3, 135, 206, 235), (0.6, 70, 130, 180), (1.0, 25, 25, 112)]
FUTURE = [(0.0, 255, 223, 0), (0.4, 255, 165, 0), (0.7, 255, 69, 0), (1.0, 80, 0, 0)]

# Place of the sun model (degrees) and short names of the days, Sunday first.
SUN_LATITUDE, SUN_LONGITUDE = 55.6061, 13.0007
WEEKDAYS = ["sön", "mån", "tis", "ons", "tors", "fre", "lör"]
MONTHS = ["jan.", "feb.", "mars", "apr.", "maj", "juni", "juli", "aug.", "sep.", "okt.", "nov.", "dec."]


def parameter(name: str) -> tuple[str, str, str, str]:
    """Unit, name, English name and folder; raises ValueError for an unknown parameter."""
    if name not in PARAMETERS:
        raise ValueError(f"unknown parameter: {name}")
    return PARAMETERS[name]


def rgb(colour: str) -> tuple[int, int, int]:
    return tuple(int(colour[i : i + 2], 16) for i in (1, 3, 5))
