"""Default tracked species for the per-species metrics and charts."""

# The tracked scientific names, by group, in their original order.
PLANTS = (
    "Anemonastrum canadense",
    "Pulsatilla nuttalliana",
    "Thermopsis rhombifolia",
    "Monarda fistulosa",
    "Cirsium arvense",
    "Elaeagnus commutata",
    "Maianthemum stellatum",
)
SNAKES = (
    "Thamnophis elegans",
    "Thamnophis sirtalis",
)
BIRDS = (
    "Setophaga coronata",
    "Setophaga petechia",
    "Leiothlypis celata",
    "Leiothlypis peregrina",
    "Cardellina pusilla",
)
FROGS = (
    "Pseudacris maculata",
    "Ambystoma mavortium",
    "Lithobates sylvaticus",
)

ALL_TRACKED = PLANTS + SNAKES + BIRDS + FROGS
