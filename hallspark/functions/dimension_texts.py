"""What users read about the preference dimensions."""

from __future__ import annotations

# They must equal those of the source data.
#: id: (scoring mode, may be a hard requirement, description, positive, negative, unknown)
TEXTS: dict[str, tuple[str, bool, str, str, str, str]] = {
    "socialAtmosphere": ("quality", False, "How lively and social the hall tends to be.", "Matches your preference for a social atmosphere", "Less social than you prefer", "Social atmosphere is unknown"),
    "quietAtmosphere": ("quality", False, "How quiet and calm the hall tends to be.", "Matches your preference for a quieter atmosphere", "Louder / less quiet than you prefer", "Quiet vibe is unknown"),
    "roomSpaciousness": ("quality", False, "How spacious rooms feel relative to typical halls.", "Rooms are relatively spacious", "Rooms tend to feel smaller", "Room size / spaciousness is unknown"),
    "privacy": ("quality", False, "Overall privacy of living arrangements.", "Offers good privacy", "Lower privacy than you prefer", "Privacy rating is unknown"),
    "bathroomPrivacy": ("quality", False, "How private bathrooms are (derived from style and ratings).", "Bathroom setup supports privacy", "Bathroom setup is less private", "Bathroom privacy cannot be assessed"),
    "privateBathroom": ("boolean_match", True, "In-room / private bathroom.", "Has a private bathroom", "Does not have a private bathroom", "Private bathroom availability is unknown"),
    "suiteBathroom": ("boolean_match", True, "Bathroom shared within a suite.", "Has a suite-style bathroom", "Does not have a suite bathroom", "Suite bathroom availability is unknown"),
    "communalBathroomOk": ("boolean_match", False, "Comfortable with floor / communal bathrooms.", "Communal bathroom matches what you accept", "Not a communal bathroom setup", "Bathroom style is unknown"),
    "roomTypeSingle": ("boolean_match", True, "Access to single (one-person) rooms.", "Offers single rooms", "No single rooms available", "Single room availability is unknown"),
    "roomTypeDouble": ("boolean_match", False, "Traditional double rooms.", "Offers double rooms", "No double rooms listed", "Double room availability is unknown"),
    "suiteStyle": ("categorical", False, "Suite-style residence halls.", "Suite-style living", "Not suite-style", "Housing style is unknown"),
    "apartmentStyle": ("categorical", False, "Apartment or townhouse independence.", "Apartment-style independence", "Not apartment-style", "Housing style is unknown"),
    "corridorStyle": ("categorical", False, "Classic corridor-style residence hall.", "Traditional corridor-style hall", "Not a traditional corridor hall", "Housing style is unknown"),
    "renovatedNewer": ("quality", False, "Recently renovated or newer construction.", "Newer or recently renovated", "Older building / not recently renovated", "Building age / renovation status is unknown"),
    "cleanliness": ("quality", False, "Reported cleanliness of the hall.", "Rated as clean", "Cleanliness rated lower", "Cleanliness is unknown"),
    "airConditioning": ("boolean_match", True, "Building has air conditioning.", "Has air conditioning", "No air conditioning", "AC availability is unknown"),
    "naturalLight": ("quality", False, "Rooms get good natural light.", "Good natural light", "Limited natural light", "Natural light is unknown"),
    "storage": ("quality", False, "In-room and building storage options.", "Decent storage options", "Limited storage", "Storage options are unknown"),
    "studyEnvironment": ("boolean_match", False, "Quiet study spaces and study-friendly vibe.", "Supports studying (lounges / quieter vibe)", "Weaker study environment signals", "Study environment is unknown"),
    "commonLounges": ("boolean_match", False, "Shared lounge / common spaces.", "Has common lounges", "No lounge access listed", "Lounge availability is unknown"),
    "kitchens": ("boolean_match", False, "Kitchen or cooking access in the building.", "Kitchen access available", "No kitchen access listed", "Kitchen access is unknown"),
    "laundry": ("boolean_match", False, "In-building laundry access.", "Laundry access in building", "No laundry access listed", "Laundry access is unknown"),
    "buildingAmenities": ("quality", False, "Overall amenity richness (count / variety).", "Strong amenity set", "Fewer amenities", "Amenity details are unknown"),
    "freshmanFriendly": ("boolean_match", True, "Open to and suitable for first-year students.", "Freshman-eligible", "Not freshman-eligible", "Freshman eligibility is unknown"),
    "upperclassFriendly": ("boolean_match", True, "Open to upperclass students.", "Upperclass-eligible", "Not upperclass-eligible", "Upperclass eligibility is unknown"),
    "communityAtmosphere": ("quality", False, "Sense of community in the hall.", "Strong community feel", "Weaker community signals", "Community atmosphere is unknown"),
    "livingLearning": ("boolean_match", False, "Living-learning community, honors, or themed housing.", "Living-learning or themed community", "Not a themed / LLC hall", "Themed housing status is unknown"),
    "genderInclusive": ("boolean_match", True, "Gender-inclusive housing options.", "Gender-inclusive housing", "Not listed as gender-inclusive", "Gender-inclusive status is unknown"),
    "substanceFree": ("boolean_match", True, "Substance-free housing community.", "Substance-free community", "Not substance-free", "Substance-free status is unknown"),
    "accessibility": ("boolean_match", True, "Accessible rooms / elevator / ADA features.", "Accessibility features available", "Accessibility features not listed", "Accessibility information is unknown"),
    "proximityAcademic": ("proximity", False, "Proximity to academic buildings / classrooms.", "Close to academic buildings", "Farther from classes", "Distance to classes is unknown"),
    "proximityDining": ("proximity", False, "Proximity to dining halls.", "Close to dining", "Farther from dining", "Distance to dining is unknown"),
    "proximityGym": ("proximity", False, "Proximity to recreation / gym facilities.", "Close to the gym", "Farther from the gym", "Distance to gym is unknown"),
    "proximityLibrary": ("proximity", False, "Proximity to campus libraries.", "Close to the library", "Farther from the library", "Distance to library is unknown"),
    "proximitySocial": ("proximity", False, "Proximity to student unions / social areas.", "Close to social hubs", "Farther from social hubs", "Distance to social hubs is unknown"),
    "proximityParking": ("proximity", False, "Proximity to parking.", "Close to parking", "Farther from parking", "Distance to parking is unknown"),
    "walkability": ("quality", False, "Overall walkability on campus from this hall.", "Highly walkable location", "Less walkable location", "Walkability is unknown"),
    "location": ("proximity", False, "Composite campus location convenience.", "Convenient campus location", "Less convenient location", "Location distances are unknown"),
    "affordability": ("cost", True, "Lower yearly cost is better.", "More affordable relative to peers", "Higher cost relative to peers", "Cost is unknown"),
    "value": ("cost", False, "Quality relative to cost.", "Strong value for the cost", "Weaker value for the cost", "Value cannot be assessed without cost/quality data"),
    "buildingSizeSmall": ("quality", False, "Preference for smaller residence halls.", "Smaller building size", "Larger building than preferred", "Building size is unknown"),
    "buildingSizeLarge": ("quality", False, "Preference for larger residence halls.", "Larger building size", "Smaller building than preferred", "Building size is unknown"),
    "elevator": ("boolean_match", True, "Building has elevator access.", "Has elevator access", "No elevator listed", "Elevator access is unknown"),
    "traditionalDormExperience": ("categorical", False, "Classic residence-hall community experience.", "Traditional dorm experience", "Less of a traditional dorm setup", "Housing style is unknown"),
    "apartmentIndependence": ("boolean_match", False, "Independent living with kitchen / apartment features.", "Supports independent apartment-style living", "Less independent living setup", "Independence features are unknown"),
    "overallSatisfaction": ("quality", False, "Aggregate student satisfaction / overall score.", "High overall satisfaction", "Lower overall satisfaction", "Overall satisfaction is unknown"),
}
